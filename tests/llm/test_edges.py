"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from skein.llm import bpe, decontaminate, katz, language, licenses, merkle, neardup, quality, records, secrets
from skein.llm import common as C

LONG = "lorem ipsum dolor sit amet " * 40_000
CLASH = "score double, digest string, tie string, id string, root string, bands string, n_tokens int, start int, kind string, quality string, lang string, source string, n_chars long"
EXTRA = (0.5, "d", "t", "i", "r", "b", 1, 2, "k", "q", "en", "s", 7)
ROWS = [(1, "red fox jumps over the lazy dog again and again"), (1, "red fox jumps over the lazy dog again and again"), (None, "no id at all"), (2, None), (3, ""), (4, LONG), (5, "word"), (5, "other text of the same id"), (6, "   \n\t ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in ROWS], f"doc_id long, text string, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (5, 0), (2, None), (None, 1), (77, 0)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "fox jumps over the lazy dog"), (2, None), (3, "..."), (None, "x"), (4, "Fox jumps, over the LAZY dog")], "item_id long, text string")


def test_quality(docs, none, labels):
    model = quality.train(docs, labels)
    assert quality.scored(docs, model).count() == len(ROWS)
    assert quality.scored(none, model).count() == 0
    empty = quality.train(none, labels)
    assert {r.decision for r in quality.scored(docs, empty).collect()} == {"accept"}
    assert quality.scored(docs, empty, keep_rows=True).columns == docs.columns


def test_merkle(spark):
    rows = [(1, "u", "<p>", 1), (1, "u", "<p>", 1), (2, None, None, 1), (None, "n", "x", 1), (-5, "m", LONG, 1), (2**62, "far", "y", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    assert merkle.audit(pages, pages.repartition(2)).count() == 0
    assert merkle.audit(pages.where("1 = 0"), pages.where("1 = 0")).count() == 0
    assert {r.problem for r in merkle.audit(pages, pages.where("1 = 0")).collect()} == {"missing"}
    assert merkle.audit(pages.where("1 = 0"), pages).count() == len(rows)


def test_language(docs, none):
    assert language.identify(docs, {}).where("language <> 'und'").count() == 0
    content = {"en": b"the quick red fox and the dog " * 30, "fr": "le renard brun et le chien gris ".encode() * 30}
    got = language.identify(docs, content).collect()
    assert len(got) == len(ROWS) and {r.language for r in got if r.doc_id in (2, 3)} == {"und"}
    assert language.identify(none, content).count() == 0
    assert language.dictionaries(none) == {} and set(language.dictionaries(docs)) == {"en"}


def test_secrets(docs, none):
    assert secrets.scan(docs).count() == 0 and secrets.scan(none).count() == 0
    assert sorted(map(str, secrets.redact(docs).collect())) == sorted(map(str, docs.collect()))


def test_decontamination(docs, none, benchmark):
    assert {(r.doc_id, r.item_id, r.n_matches) for r in decontaminate.matches(docs, benchmark).collect()} == {(1, 1, 2), (1, 4, 2)}
    assert decontaminate.clean(docs, benchmark).count() == len(ROWS) - 2
    assert decontaminate.clean(docs, benchmark.where("1 = 0")).count() == len(ROWS)
    assert decontaminate.matches(none, benchmark).count() == 0


def test_bpe(docs, none):
    got = bpe.encode(docs).collect()
    assert len(got) == len(ROWS) and all(r.round_trip for r in got if r.token_ids is not None)
    assert [r.n_tokens for r in got if r.token_ids is None] == [0] and bpe.encode(none).count() == 0


def test_records(docs, none, tmp_path):
    index = records.write(docs, f"file://{tmp_path}/a")
    assert index.count() == len(ROWS)
    assert records.write(none, f"file://{tmp_path}/b").count() == 0
    assert records.read(index.orderBy("n_bytes"), f"file://{tmp_path}/a").count() == len(ROWS)


def test_near_dedup(docs, none):
    got = neardup.groups(docs).collect()
    assert sorted((r.doc_id, r.group_id, r.kept) for r in got) == [(1, 1, False), (1, 1, True)]
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1
    assert neardup.groups(none).count() == 0 and neardup.deduplicated(none).count() == 0


def test_katz(docs, none):
    got = katz.score(docs).collect()
    assert len(got) == len(ROWS) and {r.n_words for r in got if r.perplexity is None} == {0}
    assert katz.score(none).count() == 0


def test_licenses(docs, none):
    assert licenses.scan(docs).count() == 0 and licenses.scan(none).count() == 0


def test_stages_keep_columns(spark, docs, none, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(ROWS)


def test_invalid_utf8_is_replaced():
    import pyarrow as pa

    col = pa.array([b"ab\xff", b"c"], pa.binary()).view(pa.string())
    cp, at = C.codepoints(col)
    assert cp.tobytes().decode("utf-32-le") == "ab�c" and at.tolist() == [0, 3, 4]
