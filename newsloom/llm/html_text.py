"""Main text of web pages by minimum-cut labelling of their blocks.

A linear classifier says how likely each block is content; the costs of either label
become its capacities to the two terminals.  Neighbouring blocks, and blocks next to each
other inside one element, are joined by edges that are the heavier the nearer they are in
the tree, so that a cut between them costs.  Maximum flow finds the labelling of least
total cost: blocks still reachable from the content terminal are content.

There are no labelled pages to fit the classifier on; its weights are fixed below.

Defined results: NULL, empty and textless pages have the empty text; repeated pages get
equal rows; pages without id are read like others; broken markup is read as far as it
goes, and unclosed comments and scripts run to the end of the page; other columns are
ignored.  Pages are read whole, and one after the other.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.llm.html_blocks import HEADINGS, Block, read_blocks

#: Evidence for content, in log-odds.
IN_ARTICLE, IN_BOILERPLATE, HEADING = 5.0, -9.0, 0.5
START, PER_LOG_CHAR, PER_SENTENCE, LINK_SHARE = -0.2, 0.4, 0.3, -4.0
MOST_SENTENCES = 5
#: Weight of an edge between neighbours and between siblings, and how fast distance in the
#: tree takes it away.
NEIGHBOUR, SIBLING, REACH = 0.8, 0.4, 2.0


def log_odds(block: Block) -> float:
    size = len(block.text)
    sentences = sum(block.text.count(mark) for mark in ".!?")
    z = START + PER_LOG_CHAR * math.log(size + 1) + PER_SENTENCE * min(sentences, MOST_SENTENCES)
    z += LINK_SHARE * min(block.link_chars / size, 1.0)
    if block.article:
        z += IN_ARTICLE
    if block.tag in HEADINGS:
        z += HEADING
    if block.boilerplate:
        z += IN_BOILERPLATE
    return max(min(z, 12.0), -12.0)


def edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    out = []
    last_child: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            out.append((i - 1, i, NEIGHBOUR * math.exp(-block.gap / REACH)))
        before = last_child.get(block.parent)
        if before is not None:
            out.append((before, i, SIBLING))
        last_child[block.parent] = i
    return out


def minimum_cut(gains: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of the minimum cut.  ``gains`` are the
    capacity from the source less that to the sink, which is all that matters of them.

    Shortest augmenting paths by levels; levels end at nodes with room to the sink."""
    n = len(gains)
    excess = [max(g, 0.0) for g in gains]
    room = [max(-g, 0.0) for g in gains]
    heads: list[int] = []
    left: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, weight in links:
        for x, y in ((a, b), (b, a)):
            out[x].append(len(heads))
            heads.append(y)
            left.append(weight)
    tiny = 1e-12
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if excess[i] > tiny)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            reached = reached or room[i] > tiny
            for e in out[i]:
                if left[e] > tiny and level[heads[e]] < 0:
                    level[heads[e]] = level[i] + 1
                    queue.append(heads[e])
        if not reached:
            return [x >= 0 for x in level]
        following = [0] * n
        for start in range(n):
            while excess[start] > tiny:
                path: list[int] = []
                i = start
                while True:
                    if room[i] > tiny and (path or room[start] > tiny):
                        flow = min([excess[start], room[i], *(left[e] for e in path)])
                        excess[start] -= flow
                        room[i] -= flow
                        for e in path:
                            left[e] -= flow
                            left[e ^ 1] += flow
                        break
                    while following[i] < len(out[i]):
                        e = out[i][following[i]]
                        if left[e] > tiny and level[heads[e]] == level[i] + 1:
                            break
                        following[i] += 1
                    if following[i] < len(out[i]):
                        path.append(e)
                        i = heads[e]
                    elif path:  # a dead end: not this way again
                        i = heads[path.pop() ^ 1]
                        following[i] += 1
                    else:
                        break
                else:
                    continue
                if following[start] >= len(out[start]) and room[start] <= tiny:
                    break


def main_text(page: str) -> str:
    blocks = read_blocks(page)
    if not blocks:
        return ""
    content = minimum_cut([log_odds(b) for b in blocks], edges(blocks))
    return "\n".join(b.text for b, is_content in zip(blocks, content) if is_content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(page.as_py() or "") for page in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        part.column("url"),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    ["page_id", "url", "text", "n_chars"],
                )

    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(extracted, f"page_id {kind}, url string, text string, n_chars long")
