"""Every stage against a brute-force version of its decisions, on its own input."""

from collections import Counter

import pytest
from test_decontam import plain as overlaps
from test_sharding import check as check_shards
from test_simhash import plain_fingerprint, plain_groups

import corpus_pipeline
from roadpulse.llm import language, mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(llm):
    """The input of each stage and the last stage's result, as local rows."""
    docs, rows = llm.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        rows[name] = docs.collect()
        docs = corpus_pipeline.written(stage(llm, docs, SF), name)
    rows["result"] = docs.collect()
    return rows


def kept(inputs, stage):
    names = [*[n for n, _ in corpus_pipeline.STAGES], "result"]
    return Counter(r["doc_id"] for r in inputs[names[names.index(stage) + 1]])


def test_order_and_columns(llm, inputs):
    assert list(inputs)[:-1] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    for name in list(inputs)[1:-1]:
        assert inputs[name][0].asDict().keys() == inputs["language_id"][0].asDict().keys()


def test_language_id(inputs):
    want = [r["doc_id"] for r in inputs["language_id"] if any(map(str.isalpha, r["text"] or ""))]
    assert kept(inputs, "language_id") == Counter(want)


def test_near_dedup(inputs):
    docs = inputs["near_dedup"]
    group = plain_groups([plain_fingerprint(r["text"]) for r in docs], 2)
    first = {}
    for r, g in zip(docs, group):
        first[g] = min(first.get(g, r["doc_id"]), r["doc_id"])
    assert kept(inputs, "near_dedup") == Counter(first.values())


def test_decontamination(llm, inputs):
    items = [r["text"] for r in llm.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [r for r in inputs["decontamination"] if len(r["text"]) < 3000]  # brute force is slow
    left = kept(inputs, "decontamination")
    assert docs and all((r["doc_id"] in left) != any(overlaps(r["text"], q) for q in items) for r in docs)


def test_mixing(llm, inputs):
    docs = llm.createDataFrame(inputs["mixing"])
    labels = llm.read.parquet(f"{SF}/labels.parquet")
    want = {r["doc_id"]: r["copies"] for r in mixing.mixture(docs, labels).collect()}
    assert kept(inputs, "mixing") == Counter({k: v for k, v in want.items() if v})


def test_sharding(inputs):
    docs = [(r["doc_id"], r["text"]) for r in inputs["sharding"]]
    check_shards(docs, inputs["result"], 24)


def test_run_equals_stages(llm, inputs):
    got = corpus_pipeline.run(llm, SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, inputs["result"]))


def test_empty_documents(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(llm, docs, SF).count() == 0


def test_language_of_the_whole_corpus(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    assert language.identify(docs).count() == docs.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, `member` string, `rate` int"


def edge_tables(llm, tmp_path, rows, benchmark, labels):
    """The tables that the stages read, as a folder."""
    sf = f"{tmp_path}/sf"
    docs = llm.createDataFrame([(i, t, lang, None, None if t is None else len(t), 9, "m", 3) for i, t, lang in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{sf}/documents.parquet")
    llm.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    llm.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf


def test_edge_cases(llm, tmp_path):
    """Nulls, empty and long texts, repeats, extra and clashing columns, through all stages."""
    words = "river mountain forest market garden window bridge letter candle winter summer morning".split()
    say = lambda k, n=40: " ".join(words[(k * 7 + j * (k % 5 + 1)) % 12] + str((k * j) % 11) for j in range(n))
    item = " ".join(f"item{j}" for j in range(20))
    rows = [(i, say(i), "en") for i in range(60)] + [(3, say(3), "en"), (3, say(3), "en"), (70, say(5), None)]
    rows += [(71, None, "en"), (72, "", None), (None, "12 34 !!", "en"), (None, say(61), "en"), (73, say(62, 30000), "en")]
    rows += [(74, f"{say(63, 10)} {item} {say(64, 10)}", "en")]
    labels = [(i, int(i % 6 > 0), int(i % 6 == 1)) for i in range(50)] + [(None, 1, 0), (4, None, None)]
    sf = edge_tables(llm, tmp_path, rows, [(1, item), (None, None), (2, "")], labels)
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(llm, docs, sf), name)
        seen[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
    left = [r["doc_id"] for r in seen["language_id"]]
    assert len(left) == len(rows) - 3 and not {71, 72} & set(left)
    texts = Counter(r["text"] for r in seen["near_dedup"])
    assert max(texts.values()) == 1 and texts[rows[3][1]] == 1
    assert 74 not in {r["doc_id"] for r in seen["decontamination"]}
    assert {r["doc_id"] for r in seen["decontamination"]} == {r["doc_id"] for r in seen["near_dedup"]} - {74}
    assert {(r["member"], r["rate"], r["shard"]) for r in seen["mixing"]} == {("m", 3, 9)}
    assert Counter(r["text"] for r in seen["sharding"]) == Counter(r["text"] for r in seen["mixing"])
    check_shards([(r["doc_id"], r["text"]) for r in seen["mixing"]], seen["sharding"], 24)


def test_empty_tables(llm, tmp_path):
    sf = edge_tables(llm, tmp_path, [], [], [])
    assert corpus_pipeline.run(llm, sf).count() == 0
    docs = edge_tables(llm, tmp_path / "b", [(1, "some words here", "en"), (2, "other words there", "en")], [], [])
    assert corpus_pipeline.run(llm, docs).count() == 2
