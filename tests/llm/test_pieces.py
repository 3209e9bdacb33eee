import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from newsloom.llm import charmap, pieces

from .conftest import sentence


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(pieces.public_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())


def random_texts():
    rnd = random.Random(3)
    letters = " \n\tabcdeTHingre▁é中梦\u0000😀 .,12"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts += ["".join(rnd.choice("thering ") for _ in range(rnd.randint(60, 3000))) for _ in range(30)]
    texts += ["x" * 5000, "the" * 3000, " " * 200, "▁▁ ▁", "\n" * 50, sentence(1, 3000)]
    return texts


def test_ids_decoding_and_spans_are_those_of_the_library(model, library):
    codec, texts = pieces.codec(model), random_texts()
    for text, ids in zip(texts, codec.encode(texts)):
        expected = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == expected
        assert codec.decode(ids) == library.decode(expected).encode()
        begins, ends = codec.spans(text, ids)
        raw = text.encode()
        assert begins[0] == 0 and ends[-1] == len(raw) and (begins[1:] == ends[:-1]).all()
        for i, b, e in zip(ids.tolist(), begins, ends):
            piece = library.id_to_piece(i)
            if not piece.startswith("<") and piece.strip("▁"):
                assert piece.replace("▁", " ").strip() == raw[b:e].decode().replace("▁", " ").strip()


def test_long_texts_are_taken_in_portions(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "LONG", 200)
    texts = [sentence(s, 10 + 60 * s) for s in range(5)] + ["", "x" * 500]
    for text, ids in zip(texts, pieces.Codec(model).encode(texts)):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_memory_of_segments_is_bounded(model, monkeypatch, library):
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    codec = pieces.Codec(model)
    for text in [sentence(s, 40) for s in range(8)]:
        assert codec.encode([text])[0].tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_long_and_short_segments_merge_alike(model):
    codec = pieces.Codec(model)
    rnd = random.Random(5)
    segments = ["▁" + "".join(rnd.choice("theringoas") for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    one_by_one = [codec._ids(codec._merge_one(codec._symbols(s))) for s in segments]
    codec._learn(list(segments))
    assert [codec._known[s] for s in segments] == one_by_one


def test_documents(odd_docs, odd_rows, no_docs, model, library):
    expected = sorted(
        (str(i), library.encode(t or "", add_bos=True, add_eos=True)) for i, t in odd_rows
    )
    rows = pieces.encode(odd_docs, model).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == expected
    digests = pieces.digests(odd_docs, model).collect()
    def sha(data):
        return hashlib.sha256(data).hexdigest()

    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == sorted(
        (i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())) for i, ids in expected
    )
    assert sorted(r.span_bytes for r in digests) == sorted(len((t or "").encode()) for _, t in odd_rows)
    assert pieces.digests(no_docs, model).collect() == []


# A character map built here: the double array of a few keys, as the format has it.


def compiled(rules):
    """Blob of a character map that replaces the keys of ``rules`` by their values."""
    values, texts = {}, b""
    for key, new in sorted(rules.items()):
        values[key.encode()] = len(texts)
        texts += new.encode() + b"\0"
    units = [0] * 4096
    used, bases = {0}, set()

    def place(node, prefix):
        following = sorted({key[len(prefix)] for key in values if key.startswith(prefix) and len(key) > len(prefix)})
        here = prefix in values
        for base in range(1, 2000):
            children = [base ^ c for c in following] + ([base] if here else [])
            # Nodes share no base: a child would be taken for another node's.
            if base not in bases and not used & set(children):
                break
        used.update(children)
        bases.add(base)
        units[node] |= (node ^ base) << 10 | here << 8
        if here:
            units[base] = values[prefix] | 1 << 31
        for c in following:
            units[base ^ c] = c
        for c in following:
            place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    data = np.array(units, "<u4").tobytes()
    return len(data).to_bytes(4, "little") + data + texts


RULES = {"ﬁ": "fi", "é": "e", "é": "e", "ab": "X", "abc": "YZ", "　": " ", "Ⅷ": "VIII", "­": ""}


def test_longest_prefix_and_alignment():
    tool = charmap.CharMap(compiled(RULES))
    for key, new in RULES.items():
        assert tool.longest(key.encode(), 0) == (new.encode(), len(key.encode()))
    assert tool.longest(b"abd", 0) == (b"X", 2) and tool.longest(b"abcd", 0) == (b"YZ", 3)
    assert tool.longest(b"b", 0) is None
    text = "ﬁné ab　abc­Ⅷ"
    out, aligned = charmap.normalise(text, tool, dummy_prefix=True, squeeze=False)
    assert out == "▁fine▁X▁YZVIII"
    raw, norm = text.encode(), out.encode()
    assert len(aligned) == len(norm) + 1 and aligned[-1] == len(raw) and (np.diff(aligned) >= 0).all()
    at = norm.index(b"X")
    assert raw[aligned[at] : aligned[at + 1]] == b"ab"
    at = norm.index(b"VIII")
    assert raw[aligned[at] : aligned[at + 4]].decode() == "Ⅷ"


def test_squeezed_spaces():
    none = charmap.CharMap(b"")
    assert charmap.normalise("  a  b ", none, True, True)[0] == "▁a▁b"
    assert charmap.normalise("   ", none, True, True)[0] == ""
    out, aligned = charmap.normalise(" é  b", none, False, True)
    assert out == "é▁b" and aligned.tolist() == [1, 2, 3, 3, 3, 5, 6]
