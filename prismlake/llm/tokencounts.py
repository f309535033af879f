"""Token counts that follow edits, by a kept tree of pre-tokens for each document.

The tokenizer's own regular expression cuts a text into pre-tokens, and no token crosses a cut; an added token of the
tokenizer's file (as ``<|endoftext|>``) is a pre-token of one token. A tree over the pre-tokens has some of them, with
their text, in each leaf, and in each node the sums of characters, tokens and pre-tokens below. ``build`` makes a
table of such trees with their roots' sums; ``apply`` takes the table and edits and gives the table after them.

An edit replaces a range of characters: cutting starts again at the last edge that the edit can't have changed, since a
cut depends on at most ``context`` characters after it, and stops at the first new edge after the edit that is also an
old edge, from where the text is the same. Only the pre-tokens in between are encoded; their leaves are replaced, and
the sums of the nodes above are updated, some for each level. Nodes that grow too wide are split, so that an edit
costs its own length and the tree's height, not the document's length. In the table a tree is its leaves in order; the
nodes above come back from the leaves' sums.

Defined cases: null text is empty and counts 0; edits are clipped to the text; an empty edit changes nothing; a null
edit or place counts as none or 0; rows that repeat a doc_id are counted each for itself; an empty table gives no
rows; ``build`` keeps all other columns but the text, which is in the tree (columns named tree, n_tokens and pre_tokens
are replaced); of very long texts only the region of the edit is encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm.packing import Encoder
from prismlake.llm.session import small_batches, table, written

#: Pre-tokens of a leaf and children of a node, at most twice as many.
LEAF, FAN = 256, 16
#: Pre-tokens whose counts one Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000

TREE = "array<struct<text:string,sizes:binary,counts:binary>>"


class Counter:
    """Pre-tokens and their token counts for one tokenizer."""

    def __init__(self, path: str):
        import regex

        self.encoder = Encoder(path)
        self.cut = regex.compile(self.encoder.pattern)
        self.added = sorted(self.encoder.special, key=len, reverse=True)
        self.find_added = self.encoder.cut
        self.context = max([2, *map(len, self.added)])
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if self.find_added is None or not self.find_added.search(text):
            return self.cut.findall(text)
        out, at = [], 0
        for m in self.find_added.finditer(text):
            out += [*self.cut.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.cut.findall(text[at:])

    def counts(self, pre_tokens: list[str]) -> list[int]:
        known = self.known
        new = [p for p in set(pre_tokens) if p not in known]
        if new:
            if len(known) > REMEMBERED:
                known.clear()
                new = list(set(pre_tokens))
            for p in new:
                known[p] = len(self.encoder.ids(p)) // 4
        return [known[p] for p in pre_tokens]


class Node:
    """A leaf (text, sizes and counts of pre-tokens) or an inner node (children), with sums."""

    __slots__ = ("children", "text", "sizes", "counts", "chars", "tokens", "n")

    def __init__(self, children: list[Node] | None = None, text: str = "", sizes: list[int] = (), counts: list[int] = ()):
        self.children, self.text, self.sizes, self.counts = children, text, list(sizes), list(counts)
        self.add_up()

    def add_up(self) -> None:
        if self.children is None:
            self.chars, self.tokens, self.n = len(self.text), sum(self.counts), len(self.sizes)
        else:
            self.chars, self.tokens, self.n = (sum(getattr(c, x) for c in self.children) for x in ("chars", "tokens", "n"))

    def halves(self) -> list[Node]:
        """This node, or several of at most twice the usual width instead of it; none if it is empty."""
        if not self.n:
            return []
        if self.children is not None:
            if len(self.children) <= 2 * FAN:
                return [self]
            return [Node(self.children[i : i + FAN]) for i in range(0, len(self.children), FAN)]
        if self.n <= 2 * LEAF:
            return [self]
        out, at = [], 0
        for i in range(0, self.n, LEAF):
            size = sum(self.sizes[i : i + LEAF])
            out.append(Node(None, self.text[at : at + size], self.sizes[i : i + LEAF], self.counts[i : i + LEAF]))
            at += size
        return out

    def replace(self, first: int, last: int, new: Node | None) -> list[Node]:
        """The nodes that stand for this one after its pre-tokens [first, last) became those of the leaf ``new``."""
        if self.children is None:
            a, b = sum(self.sizes[:first]), sum(self.sizes[:last])
            put = new or Node()
            self.text = self.text[:a] + put.text + self.text[b:]
            self.sizes[first:last], self.counts[first:last] = put.sizes, put.counts
        else:
            out, at = [], 0
            for k, child in enumerate(self.children):
                lo, hi = max(first - at, 0), min(last - at, child.n)
                at += child.n
                takes = new is not None and (first <= at or k == len(self.children) - 1)
                if takes or lo < hi:
                    out += child.replace(min(lo, child.n), max(hi, min(lo, child.n)), new if takes else None)
                    new = None if takes else new
                else:
                    out.append(child)
            self.children = out
        self.add_up()
        return self.halves()

    def leaves(self) -> Iterator[Node]:
        if self.children is None:
            yield self
        else:
            for c in self.children:
                yield from c.leaves()

    def upto(self, n: int) -> int:
        """Tokens of the first n pre-tokens."""
        if self.children is None:
            return sum(self.counts[:n])
        total = 0
        for c in self.children:
            if n <= c.n:
                return total + c.upto(n)
            total, n = total + c.tokens, n - c.n
        return total


def grown(nodes: list[Node]) -> Node:
    """One node over some."""
    while len(nodes) > 1:
        nodes = [Node(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
    root = nodes[0] if nodes else Node()
    while root.children is not None and len(root.children) == 1:
        root = root.children[0]
    return root


def packed(numbers: list[int]) -> bytes:
    """The bytes of each number, 1, 2 or 4, and then the numbers."""
    width = 1 if max(numbers) < 1 << 8 else 2 if max(numbers) < 1 << 16 else 4
    return bytes([width]) + np.array(numbers, f"<u{width}").tobytes()


def unpacked(data: bytes) -> list[int]:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).tolist()


class CountedText:
    """A text as a tree of its pre-tokens."""

    def __init__(self, text: str, counter: Counter):
        pre_tokens = counter.pre_tokens(text)
        counts, nodes, at = counter.counts(pre_tokens), [], 0
        for i in range(0, len(pre_tokens), LEAF):
            sizes = [len(p) for p in pre_tokens[i : i + LEAF]]
            nodes.append(Node(None, text[at : at + sum(sizes)], sizes, counts[i : i + LEAF]))
            at += sum(sizes)
        self.counter, self.root = counter, grown(nodes)

    @classmethod
    def kept(cls, leaves: list[tuple[str, bytes, bytes]], counter: Counter) -> CountedText:
        """The tree whose leaves a table has."""
        self = cls.__new__(cls)
        self.counter, self.root = counter, grown([Node(None, t, unpacked(s), unpacked(c)) for t, s, c in leaves])
        return self

    def stored(self) -> list[tuple[str, bytes, bytes]]:
        return [(x.text, packed(x.sizes), packed(x.counts)) for x in self.root.leaves() if x.n]

    @property
    def text(self) -> str:
        return "".join(x.text for x in self.root.leaves())

    @property
    def tokens(self) -> int:
        return self.root.tokens

    @property
    def n(self) -> int:
        return self.root.n

    def edge_before(self, place: int) -> tuple[int, int]:
        """The number of the last pre-token that starts at or before a character, and where it starts."""
        node, first, at = self.root, 0, 0
        while node.children is not None:
            for k, c in enumerate(node.children):
                if place < at + c.chars or k == len(node.children) - 1:
                    node = c
                    break
                first, at = first + c.n, at + c.chars
        for size in node.sizes[:-1] if place < at + node.chars else node.sizes:
            if place < at + size:
                break
            first, at = first + 1, at + size
        return first, at

    def read(self, start: int) -> Iterator[str]:
        """The text from a character on, leaf by leaf."""

        def walk(node: Node, skip: int) -> Iterator[str]:
            if node.children is None:
                yield node.text[skip:]
                return
            for c in node.children:
                if skip < c.chars:
                    yield from walk(c, max(skip, 0))
                skip -= c.chars

        return walk(self.root, start)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replaces characters [start, end) by ``new``; returns how many pre-tokens were encoded."""
        whole, context = self.root.chars, self.counter.context
        start = min(max(start, 0), whole)
        end = min(max(end, start), whole)
        if start == end and not new:
            return 0
        first, edge = self.edge_before(max(start - context, 0))
        before = ""
        for part in self.read(edge):
            before += part
            if edge + len(before) >= start:
                break
        rest, text = self.read(end), before[: start - edge] + new
        done = len(text)  # from here on it is the old text from `end` on
        at, found, ended, last = 0, [], False, None
        added, find = self.counter.added, self.counter.find_added
        held = 0
        while True:
            while not ended and len(text) < at + held + 2 * context:
                part = next(rest, None)
                ended = part is None
                text += part or ""
            if at >= done:
                number, place = self.edge_before(end + at - done)
                if place == end + at - done or at == len(text) and ended:
                    last = number if place == end + at - done else self.n
                    break
            special = next((x for x in added if text.startswith(x, at)), None)
            if special:
                to, sure = at + len(special), True
            else:
                stop = find.search(text, at) if find else None
                m = self.counter.cut.match(text, at, stop.start() if stop else len(text))
                to = m.end()
                sure = ended or to + context <= len(text)
            if not sure:  # what comes next may change the cut
                held = max(2 * held, to - at + context, 64)
                continue
            found.append(text[at:to])
            at, held = to, 0
        sizes = [len(x) for x in found]
        self.root = grown(self.root.replace(first, last, Node(None, "".join(found), sizes, self.counter.counts(found))))
        return len(found)


def path_of(tokenizer: str | None) -> str:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return tokenizer


def leaf_array(trees: list[list[tuple[str, bytes, bytes]]]) -> pa.Array:
    leaves = [x for t in trees for x in t]
    parts = [pa.array([x[i] for x in leaves], kind) for i, kind in ((0, pa.string()), (1, pa.binary()), (2, pa.binary()))]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in trees])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["text", "sizes", "counts"]))


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 32) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, since trees in Python take many times their texts' room."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


#: What ``build`` and ``apply`` add to a row.
SUMS = ("n_tokens", "pre_tokens")


def build(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``docs`` with a tree and its root's sums (n_tokens, pre_tokens) instead of the text: a table to be kept."""
    path, names = path_of(tokenizer), [c for c in docs.columns if c not in ("text", "tree", *SUMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in parts_of(batches):
            made = [CountedText(text.as_py() or "", counter) for text in batch.column(len(names))]
            sums = [pa.array([getattr(t, x) for t in made], pa.int64()) for x in ("tokens", "n")]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], leaf_array([t.stored() for t in made]), *sums], [*names, "tree", *SUMS])

    small_batches(docs.sparkSession)
    kept = "".join(f"`{c}` {t}, " for c, t in docs.dtypes if c in names)
    return docs.select(*(F.col(f"`{c}`") for c in names), F.col("text").cast("string")).mapInArrow(run, f"{kept}tree {TREE}, n_tokens long, pre_tokens long")


def apply(trees: DataFrame, edits: str = "edits", tokenizer: str | None = None, with_tree: bool = True) -> DataFrame:
    """The table after the edits in a column, an array of (start, end, text) done in turn, which ``recounted`` replaces:
    the number of pre-tokens that were encoded. Without ``with_tree`` only the sums come back."""
    path, names = path_of(tokenizer), [c for c in trees.columns if c not in ("tree", edits, "recounted", *SUMS)]
    own = (["tree"] if with_tree else []) + [*SUMS, "recounted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in parts_of(batches):
            after, sums = [], []
            for leaves, changes in zip(batch.column(len(names)), batch.column(len(names) + 1), strict=True):
                kept = CountedText.kept([(x["text"], x["sizes"], x["counts"]) for x in leaves.as_py() or ()], counter)
                recounted = sum(kept.edit(e["start"] or 0, e["end"] or 0, e["text"] or "") for e in changes.as_py() or () if e)
                sums.append((kept.tokens, kept.n, recounted))
                if with_tree:
                    after.append(kept.stored())
            columns = [pa.array(c, pa.int64()) for c in (list(zip(*sums, strict=True)) or [()] * 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *([leaf_array(after)] if with_tree else []), *columns], [*names, *own])

    small_batches(trees.sparkSession)
    asked = F.col(f"`{edits}`").cast("array<struct<start:int,end:int,text:string>>")
    kept = "".join(f"`{c}` {t}, " for c, t in trees.dtypes if c in names)
    tree = f"tree {TREE}, " if with_tree else ""
    return trees.select(*(F.col(f"`{c}`") for c in names), "tree", asked.alias(edits)).mapInArrow(run, f"{kept}{tree}n_tokens long, pre_tokens long, recounted long")


def count_tokens(docs: DataFrame, edits: str = "edits", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, edited_tokens, pre_tokens, recounted of rows with an array of edits, by way of a kept table."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col(f"`{edits}`").alias("edits"))
    kept = written(build(rows, tokenizer), "zstd").withColumnsRenamed({"n_tokens": "before", "pre_tokens": "pieces"})
    after = apply(kept, "edits", tokenizer, with_tree=False)
    return after.select("doc_id", F.col("before").alias("n_tokens"), F.col("n_tokens").alias("edited_tokens"), F.col("pieces").alias("pre_tokens"), "recounted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, and after two edits of each: a twentieth of it is repeated from its first third on, then its first word goes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    third = F.floor(F.char_length("text") / 3).cast("int")
    twentieth = F.substring("text", third + 1, F.floor(F.char_length("text") / 20).cast("int"))
    double = F.struct(third.alias("start"), third.alias("end"), twentieth.alias("text"))
    first = F.struct(F.lit(0).alias("start"), F.instr("text", " ").alias("end"), F.lit("").alias("text"))
    return count_tokens(docs.withColumn("edits", F.array(double, first)))
