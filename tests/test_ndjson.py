import json
import random

import pytest

from newsloom.schema import RAW_FIELDS
from newsloom.sources import ndjson
from newsloom.sources.ndjson import first_articles, read_articles

ROW = {name: name[0] for name in RAW_FIELDS}
LINE = json.dumps(ROW)


def named(name, line=LINE):
    return line.replace('"headline": "h"', f'"headline": "{name}"').replace('["c", "h"', f'["c", "{name}"')


def without(*fields):
    return json.dumps({k: v for k, v in ROW.items() if k not in fields})


KEPT = {
    "plain": LINE,
    "extra field": json.dumps({**ROW, "x": [[1], {"k": 1}]}),
    "carriage return": LINE + "\r",
    "white space": " \t" + LINE,
    "array": json.dumps(list(ROW.values())),
    "surrogate pair": LINE.replace('"a"', '"\\ud83d\\ude00"'),
    "escaped backslash": LINE.replace('"a"', '"\\\\ud800"'),
    "key repeated in an ignored field": LINE[:-1] + ', "x": {"k": 1, "k": {"date": 2, "date": 3}}}',
    "ignored key repeated": LINE[:-1] + ', "x": 1, "x": [2]}',
    "lone surrogate in an ignored field": LINE[:-1] + ', "x": "\\ud800 \\udc00 \\\\ud800"}',
    "lone surrogate in an ignored key": LINE[:-1] + ', "\\udc00": 1}',
    "both, and an early end in a string": LINE[:-1] + ', "x": "}] \\ud83d", "x": {"k": 1, "k": 2}}',
    "empty values": json.dumps({**dict.fromkeys(RAW_FIELDS, ""), "headline": "h"}),
}
DROPPED = {
    "missing": without("date"),
    "null value": json.dumps({**ROW, "date": None}),
    "number": json.dumps({**ROW, "date": 3}),
    "list": json.dumps({**ROW, "date": ["x"]}),
    "repeated key": LINE[:-1] + ', "date": "x"}',
    "trailing": LINE + " trailing",
    "two": LINE + LINE,
    "two, comma": LINE + "," + LINE,
    "quotes": LINE.replace('"', "'"),
    "blank": "",
    "null": "null",
    "numbers": "[1,2]",
    "words": "hello",
    "text": '"x"',
    "early end": LINE + '] {"a": 1}',
    "bracket": LINE + "]",
    "short array": json.dumps(list(ROW.values())[:5]),
    "long array": json.dumps([*ROW.values(), "x"]),
    "array with number": json.dumps([*list(ROW.values())[:5], 1]),
    "array, early end": json.dumps(list(ROW.values())) + "] x",
    "lone surrogate": LINE.replace('"a"', '"\\ud800"'),
    "low surrogate after text": LINE.replace('"a"', '"\\\\ud83d\\ude00"'),
    "lone low surrogate": LINE.replace('"a"', '"\\udc00"'),
    "lone surrogate in a field and outside": LINE.replace('"a"', '"\\ud800"')[:-1] + ', "x": "\\ud800"}',
    "question mark for a surrogate": LINE.replace('"a"', '"? \\udfff"'),
    "ignored key repeated, a field too": LINE[:-1] + ', "x": 1, "x": 2, "date": "d"}',
    "ignored key repeated, a number": json.dumps({**ROW, "date": 3})[:-1] + ', "x": 1, "x": 2}',
    "ignored key repeated, trailing": LINE[:-1] + ', "x": 1, "x": 2} x',
    "ignored key repeated, early end": LINE[:-1] + ', "x": 1, "x": 2}] {"a": 1}',
    "ignored key repeated, two": LINE[:-1] + ', "x": 1, "x": 2},' + LINE,
    "ignored key repeated, not JSON": LINE[:-1] + ', "x": 1, "x": NaN}',
    "ignored key repeated, quotes": LINE[:-1] + ", \"x\": 1, \"x\": 'y'}",
    "control character": LINE.replace('"a"', '"\t"'),
    "cut": LINE[:-1],
}


def write(path, lines):
    path.write_bytes(b"\n".join(line if isinstance(line, bytes) else line.encode() for line in lines))
    return str(path)


def test_strict_lines(spark, tmp_path):
    lines = [named(name, line) for name, line in {**KEPT, **DROPPED}.items()]
    lines.append(named("bad bytes").encode().replace(b'"a"', b'"\xff"'))
    lines.append(named("no newline at the end"))
    rows = read_articles(spark, write(tmp_path / "a.json", lines)).collect()
    assert [r.headline for r in rows] == [*KEPT, "no newline at the end"]
    assert len({r.doc_id for r in rows}) == len(rows)


def strict(line):
    """The six values of a line, or None, by Python's parser."""

    def article(pairs):
        """Repeated keys count only if they are among the six of the whole line."""
        known = [k for k, _ in pairs if k in RAW_FIELDS]
        return {**dict(pairs), "repeated": len(set(known)) < len(known)}

    def refuse(constant):
        raise ValueError

    try:
        value = json.loads(line, object_pairs_hook=article, parse_constant=refuse)
    except ValueError:
        return None
    if isinstance(value, list) and len(value) == len(RAW_FIELDS):
        value = dict(zip(RAW_FIELDS, value))
    if not isinstance(value, dict) or value.get("repeated"):
        return None
    values = [value.get(name) for name in RAW_FIELDS]
    if not all(isinstance(v, str) for v in values):
        return None
    try:
        "".join(values).encode()
    except ValueError:  # a lone surrogate
        return None
    return values


def test_random_damage_against_another_parser(spark):
    chance = random.Random(11)
    pieces = ["x", "", 'a"b', "é", "\\", "[1]", "}]", "{}", "€😀"]
    extras = [1, [1, [2]], {"k": [{"z": None}]}, [[]], [{}], 1.5e3]
    tails = ["]", "}", "],", "{}", " x", ",{}", "]]", "} ]", "] ["]

    def line():
        row = {name: chance.choice(pieces) for name in RAW_FIELDS}
        if chance.random() < 0.3:
            row["x"] = chance.choice(extras)
        if chance.random() < 0.1:
            row["y"] = chance.choice(["\ud800", "a\udc00b", "\\ud800"])
        whole = list(row.values())[:6] if chance.random() < 0.2 else row
        text = json.dumps(whole, ensure_ascii="y" in row or chance.random() < 0.5)
        if chance.random() < 0.1 and text.endswith("}"):
            text = text[:-1] + chance.choice([',"z":1,"z":2}', ',"z":{"q":1,"q":2}}', ',"date":"d"}'])
        for _ in range(chance.randint(0, 2)):
            at = chance.randrange(len(text) + 1)
            new = chance.choice('{}[]",:\\ue\t0 1\r-.')
            text = chance.choice(
                [text[:at] + new + text[at:], text[:at] + text[at + 1 :], text[:at] + new + text[at + 1 :],
                 text + chance.choice(tails), chance.choice(" \t\r[\x0b") + text]
            )
        return text

    lines = [line() for _ in range(6000)]
    frame = spark.createDataFrame(list(enumerate(lines)), "number bigint, value string")
    kept = {r.number: [r[name] for name in RAW_FIELDS] for r in ndjson.parse_lines(frame).collect()}
    expected = {i: strict(text) for i, text in enumerate(lines)}
    assert {i: lines[i] for i in expected if kept.get(i) != expected[i]} == {}
    assert 1000 < len(kept) < 5000


def test_values_are_unescaped(spark, tmp_path):
    row = {**ROW, "headline": 'a "b" \\ é \n 😀', "authors": ""}
    rows = read_articles(spark, write(tmp_path / "a.json", [json.dumps(row)])).collect()
    assert {name: rows[0][name] for name in RAW_FIELDS} == row


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_articles(spark, str(tmp_path / "none.json")).count()


@pytest.fixture()
def many_files(tmp_path):
    """Four files; every third line is invalid."""
    for file in range(4):
        lines = [named(f"{file}-{i}") if i % 3 else "{}" for i in range(300)]
        write(tmp_path / f"part-{file}.json", lines)
    return str(tmp_path), [f"{file}-{i}" for file in range(4) for i in range(300) if i % 3]


@pytest.mark.parametrize("n", [0, 1, 199, 200, 201, 555, 799, 800, 801, 5000])
def test_first_rows_in_file_order(spark, many_files, monkeypatch, n):
    path, expected = many_files
    monkeypatch.setattr(ndjson, "_LEAST_BYTES", 1)
    monkeypatch.setattr(ndjson, "_BYTES_PER_ROW", 10)
    rows = first_articles(spark, path, n).collect()
    assert sorted(r.headline for r in rows) == sorted(expected[:n])


def test_only_the_beginning_of_one_file_is_parsed(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "one.json", [named(f"{i:05d}") for i in range(20_000)])
    monkeypatch.setattr(ndjson, "_LEAST_BYTES", 1)
    monkeypatch.setattr(ndjson, "_BYTES_PER_ROW", 150)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    folder = str(tmp_path / "scratch")
    try:
        rows, cut = ndjson.first_articles_cut(spark, path, 1_000, folder)
        assert sorted(r.headline for r in rows.collect()) == [f"{i:05d}" for i in range(1_000)] and cut
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert 1_000 < spark.read.parquet(folder).count() < 4_000


def test_very_long_lines_are_read(spark, tmp_path):
    long = LINE[:-1] + ', "x": "' + "z" * 30_000_000 + '"}'
    rows = read_articles(spark, write(tmp_path / "long.json", [named("long", long), named("short")])).collect()
    assert [r.headline for r in rows] == ["long", "short"]


def test_first_rows_across_blocks_of_one_file(spark, tmp_path):
    lines = [named(f"{i:05d}") if i % 2 else "x" for i in range(20_000)]
    path = write(tmp_path / "one.json", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        rows = first_articles(spark, path, 5_001).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.headline for r in rows) == [f"{i:05d}" for i in range(1, 10_003, 2)]
    assert len({r.doc_id for r in rows}) == 5_001
