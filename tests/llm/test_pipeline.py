import re

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from glossaudit.llm import mixing, pii, queries
from glossaudit.llm.ngram_join import ngram_join
from glossaudit.llm.quality_rules import quality_rules
from glossaudit.llm.stages import Stages
from test_bpe import library

DATA = "/root/testdata/sf0.001"


def written(df, folder, name):
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def test_each_stage_takes_effect_on_what_its_predecessor_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, known = docs.columns, library()
    good = written(pipeline.quality_stage(spark, docs, DATA), tmp_path, "quality")
    kept = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == kept
    single = written(pipeline.near_duplicates_stage(spark, good, DATA), tmp_path, "near_duplicates")
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in ngram_join(good).collect()}
    clean = written(pipeline.pii_stage(spark, single, DATA), tmp_path, "pii")
    texts = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert r.text == pii.redacted(texts[r.doc_id], pii.find_spans(texts[r.doc_id])[1]) and r.n_chars == len(r.text)
    mixed = written(pipeline.mixing_stage(spark, clean, DATA), tmp_path, "mixing")
    passes = {r.doc_id: r.passes for r in mixing.mix_sources(clean).collect()}
    assert mixed.columns == columns and mixed.count() == sum(passes.values())
    tokens = pipeline.encoding_stage(spark, mixed, DATA).collect()
    assert len(tokens) == mixed.count()
    texts = {r.doc_id: r.text for r in clean.collect()}
    for r in tokens[:50]:
        assert r.tokens == known.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.tokens)


def _groups(texts):
    """doc_id -> smallest linked doc_id, by comparing all pairs of word 5-gram sets."""
    sets = {}
    for i, text in texts.items():
        words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[j:j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    group, ids = {i: i for i in texts}, sorted(texts)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                group[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_run_ends_with_the_rows_of_a_plain_version(spark):
    """The whole pipeline to its last row, against plain Python on what the quality rules keep."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in kept}
    groups, known = _groups({i: r.text for i, r in rows.items()}), library()
    clean = {i: pii.redacted(r.text, pii.find_spans(r.text)[1]) for i, r in rows.items() if groups[i] == i}
    single = spark.createDataFrame([(i, t, rows[i].source) for i, t in clean.items()], "doc_id long, text string, source string")
    want = sorted((r.doc_id, known.encode_ordinary(clean[r.doc_id])) for r in mixing.mix_sources(single).collect() for _ in range(r.passes))
    got = pipeline.run(spark, DATA).collect()
    assert want and sorted((r.doc_id, r.tokens) for r in got) == want
    assert all(r.n_tokens == len(r.tokens) for r in got)


def test_stages_compose_without_being_written(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    lazy = docs
    for _, stage in pipeline.STAGES:
        lazy = stage(spark, lazy, DATA)
    assert lazy.count() > 0


def test_drop_without_names_deletes_nothing(spark):
    tables = Stages(spark, "kept")
    kept = tables.keep(spark.range(3), "one")
    tables.drop()
    assert kept.count() == 3
    tables.drop_all()
    assert not tables.paths


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(queries.oracle_sql()) <= set(queries.queries())
