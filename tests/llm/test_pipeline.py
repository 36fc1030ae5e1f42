"""The stages on odd inputs, and the pipeline against its parts."""

import pytest

import corpus_pipeline as C
from gradebook.llm import minhash_dedup, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_are_the_five_in_order():
    assert [n for n, _ in C.STAGES] == ["toxicity", "language_id", "line_dedup", "near_duplicates", "packing"]


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_odd_empty_and_clashing(spark, odd_docs, no_docs, clashing_docs, name, stage):
    for docs in (odd_docs, no_docs, clashing_docs):
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
            ids = {r.doc_id for r in out.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        else:
            assert out.count() >= docs.count()


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = C.table(spark, SF, "documents"), []
    for name, stage in C.STAGES:
        out.append(docs)
        docs = C.stored(stage(spark, docs, SF), f"test-{name}")
    return [*out, docs]


def test_what_each_stage_drops(spark, steps):
    start, mild, known, lines, single, packed = steps
    scorer = toxicity.fit(start, C.table(spark, SF, "labels"))
    want = {r.doc_id for r in toxicity.score(start, scorer).where("score < 0.3").collect()}
    assert {r.doc_id for r in mild.collect()} == want
    assert known.count() == mild.count()                                  # every text of this table has a language
    left = {r.doc_id: r.text for r in lines.collect()}
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    before = {r.doc_id: r.text for r in known.collect()}
    assert all(set(left[i].split("\n")) <= set(before[i].split("\n")) | {""} for i in left)
    near = minhash_dedup.near_duplicates(lines).collect()
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in near if r.kept}
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in single.collect()}


def test_run_equals_the_stages(spark, steps):
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = C.run(spark, SF).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, steps[-1].select(*cols).collect()))


def test_texts_of_no_known_language_go(spark):
    import base64
    import random
    rng = random.Random(1)
    russian = "Вчера вечером мы долго гуляли по старому городу и говорили о книгах. " * 6
    japanese = "昨日の夜、私たちは古い町を長い間歩いて、本について話しました。" * 8
    noise = " ".join("".join(rng.choice("qwertyuiopasdfghjklzxcvbnm") for _ in range(rng.randint(2, 9))) for _ in range(80))
    coded = base64.b64encode(rng.randbytes(600)).decode()
    docs = C.table(spark, SF, "documents").select("doc_id", "text", "lang")
    planted = [(-1 - i, t, None) for i, t in enumerate((russian, japanese, noise, coded))]
    both = docs.union(spark.createDataFrame(planted, docs.schema))
    kept = {r.doc_id for r in C.drop_unknown_language(spark, both, SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_columns_of_the_input_pass_whatever_their_names(spark):
    from pyspark.sql import functions as F
    docs = C.table(spark, SF, "documents").limit(20)
    names = ["_toxicity", "_lang_pred", "_lang_score", "_removed_lines", "_line_count", "row", "size"]
    own = docs.withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    for stage in (C.drop_toxic, C.drop_unknown_language, C.drop_repeated_lines, C.drop_near_duplicates):
        out = stage(spark, own, SF)
        assert out.columns == own.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)


def test_near_copies_do_not_stay_as_fragments(spark):
    """Copies with one word in 60 changed: after the line stage and the near-duplicate stage a third at most is left (those with
    two changes in most lines), and the first ones stay."""
    import random
    rng = random.Random(2)
    docs = C.table(spark, SF, "documents").where("length(text) > 1500").orderBy("doc_id").limit(40)
    base = [(r.doc_id, r.text, r.lang) for r in docs.collect()]

    def changed(text):
        words = text.split(" ")
        for i in range(len(words)):
            if rng.random() < 1 / 60:
                words[i] = "".join(rng.choice("bcdfgaeiou") for _ in range(7))
        return " ".join(words)

    planted = [(100_000 + 1000 * k + i, changed(t), lang) for k in range(3) for i, t, lang in base]
    both = spark.createDataFrame(base + planted, "doc_id long, text string, lang string").repartition(4)
    lines = C.stored(C.drop_repeated_lines(spark, both, SF), "planted-lines")
    out = {r.doc_id for r in C.drop_near_duplicates(spark, lines, SF).collect()}
    alone = {r.doc_id for r in C.drop_near_duplicates(spark, docs.select("doc_id", "text", "lang"), SF).collect()}
    assert len([i for i in out if i >= 100_000]) <= 0.35 * len(planted)
    assert len(out & alone) >= 0.9 * len(alone)


def test_lines_of_many_documents_cost_only_those_lines(spark):
    """Half of a page in lines that other pages share, each from another page: the page stays without them."""
    # Two words differ between the lines of two pages: those that differ in one are near copies.
    shared = [f"shared line {i} with a few more words that make line {i} as long as that" for i in range(6)]
    rows = [(i, f"{shared[i]}\nthe own text of page {i} and nothing else but page {i}") for i in range(6)]
    rows += [(10, "\n".join(shared) + "\nits own text, a line"), (11, rows[2][1] + "\nand a little more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.text for r in C.drop_repeated_lines(spark, docs, SF).collect()}
    assert out == {**dict(rows[:6]), 10: "its own text, a line"}


def test_short_repeated_lines_go(spark):
    long = "one two three four five six seven eight"
    own = "some more words that make up most of what this page has, page "
    rows = [(1, f"Home | About\nshare this page\n{long}\n"), (2, f"home |  about\nshare that page\n{own}2"), (3, f"HOME | ABOUT\n\n{long} nine\n\nshare this page\nlast {own * 2}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    out = {r.doc_id: r.text for r in C.drop_repeated_lines(spark, docs, SF).collect()}
    assert out == {1: rows[0][1], 2: f"share that page\n{own}2", 3: f"\n\nlast {own * 2}"}
