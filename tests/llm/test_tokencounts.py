"""Edit-aware counts against counting the whole edited text again."""

import public_tokenizers
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismlake.llm import tokencounts

PATH = public_tokenizers.path("byte_bpe_50k.json")
COUNTER = tokencounts.Counter(PATH)
WHOLE = Tokenizer.from_file(PATH)

text = st.text(st.sampled_from("ab'slt  \n\t.,1é日 "), max_size=40)
pieces = st.lists(st.one_of(text, st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "<|", "|>", "  ", "x <|endoftext|>  y"])), max_size=6).map("".join)


def length(plain):
    return len(WHOLE.encode(plain, add_special_tokens=False).ids)


def check(kept, plain):
    again = tokencounts.CountedText(plain, COUNTER)
    assert kept.text == plain and kept.tokens == again.tokens == length(plain) and kept.n == again.n
    cuts = [[s for x in t.root.leaves() for s in x.sizes] for t in (kept, again)]
    assert cuts[0] == cuts[1] and sum(cuts[0]) == len(plain) == kept.root.chars
    assert [kept.root.upto(k) for k in range(kept.n + 1)] == [again.root.upto(k) for k in range(again.n + 1)]

    def sums(node):
        if node.children is not None:
            assert 1 < len(node.children) <= 2 * tokencounts.FAN
            for x in ("chars", "tokens", "n"):
                assert getattr(node, x) == sum(getattr(c, x) for c in node.children)
            for c in node.children:
                sums(c) if c.children is None or len(c.children) > 1 else None
        else:
            assert (node.chars, node.n, node.tokens) == (len(node.text), len(node.sizes), sum(node.counts)) and node.n <= 2 * tokencounts.LEAF

    sums(kept.root)


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(pieces, st.lists(st.tuples(st.integers(0, 90), st.integers(0, 90), pieces), max_size=4), st.sampled_from([(1, 2), (3, 2), (256, 16)]))
def test_edits(start_text, edits, widths):
    before = tokencounts.LEAF, tokencounts.FAN
    tokencounts.LEAF, tokencounts.FAN = widths
    try:
        kept = tokencounts.CountedText(start_text, COUNTER)
        plain = start_text
        check(kept, plain)
        for a, b, new in edits:
            a = min(a, len(plain))
            b = min(max(a, b), len(plain))
            kept.edit(a, b, new)
            plain = plain[:a] + new + plain[b:]
            check(kept, plain)
            kept = tokencounts.CountedText.kept(kept.stored(), COUNTER)
            check(kept, plain)
    finally:
        tokencounts.LEAF, tokencounts.FAN = before


def test_long_runs_of_white_space():
    plain = "a" + " " * 3000 + "b c" + " " * 700
    for a, b, new in ((1500, 1500, "x"), (2, 2999, ""), (5, 5, "\n" * 900), (900, 1200, "")):
        kept = tokencounts.CountedText(plain, COUNTER)
        kept.edit(a, b, new)
        check(kept, plain[:a] + new + plain[b:])


def test_only_the_edited_region_is_encoded_and_its_path_summed():
    kept = tokencounts.CountedText("some words here " * 40_000, COUNTER)
    untouched = {id(x) for x in kept.root.leaves()}
    assert kept.edit(8000, 8004, "other") <= 24 and kept.edit(300_000, 300_000, "some new words ") <= 24
    assert len({id(x) for x in kept.root.leaves()} & untouched) >= len(untouched) - 4


def test_kept_table(spark, tmp_path):
    """A table of trees is written, read, edited and written again; other columns stay."""
    texts = ["one two  three\n" * 300, "", None, "end <|endoftext|> here"]
    docs = spark.createDataFrame([(i, t, "mine", 7) for i, t in enumerate(texts)], "doc_id long, text string, counts string, n int")
    tokencounts.build(docs).write.parquet(str(tmp_path / "0"))
    plain = [t or "" for t in texts]
    for step, (a, b, new) in enumerate(((4, 7, "2"), (0, 0, "a <|endof"), (9, 9, "text|> b"))):
        kept = spark.read.parquet(str(tmp_path / str(step)))
        edits = F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(new).alias("text")), F.lit(None))
        tokencounts.apply(kept.withColumn("edits", edits)).drop("recounted").write.parquet(str(tmp_path / str(step + 1)))
        for i, t in enumerate(plain):
            a_, b_ = min(a, len(t)), min(b, len(t))
            plain[i] = t[:a_] + new + t[b_:]
        rows = spark.read.parquet(str(tmp_path / str(step + 1))).orderBy("doc_id").collect()
        assert [r.n_tokens for r in rows] == [length(t) for t in plain] and {(r.counts, r.n) for r in rows} == {("mine", 7)}
        assert ["".join(x.text for x in r.tree) for r in rows] == plain


def test_rows(spark):
    rows = [(1, "a b c", [(0, 1, "xyz")]), (2, None, [(0, 5, "one two")]), (3, "", None), (1, "a b c", [(0, 1, "xyz")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>")
    got = sorted((r.doc_id, r.n_tokens, r.edited_tokens) for r in tokencounts.count_tokens(docs).collect())
    n = len(WHOLE.encode("xyz b c", add_special_tokens=False).ids)
    assert got == [(1, 3, n), (1, 3, n), (2, 0, 2), (3, 0, 0)]
    assert tokencounts.count_tokens(docs.limit(0)).collect() == []
