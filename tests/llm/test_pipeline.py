import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lakeglass.llm import decontamination, jaccard_join, language_id, toxicity
from lakeglass.llm.queries import held_out


def test_stages_apply_their_decisions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    # Stage by stage, decided here from the operators' own results.
    now = docs
    net = toxicity.learn(now.where(~held_out()), labels.where(~held_out()))
    kept = {i: t for i, t in kept.items() if net.score([t])[0] < corpus_pipeline.TOXIC_SCORE}
    now = docs.where(docs.doc_id.isin(list(kept)))
    model = language_id.learn(now.where(~held_out()))
    kept = {i: t for i, t in kept.items() if model.predict([t])[0] != ["und"]}
    groups = jaccard_join.exact_components(kept)
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    now = docs.where(docs.doc_id.isin(list(kept)))
    bad = {r["doc_id"] for r in decontamination.contamination(now, spark.read.parquet(f"{small}/benchmark.parquet")).where("contaminated").collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in kept.items() if i not in bad}
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, small).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_stages_survive_odd_and_no_rows(spark, small, odd_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, small).count() == 0
    ids = sorted(r["doc_id"] for r in odd_docs.collect())
    kept = {name: sorted(r["doc_id"] for r in stage(spark, odd_docs, small).collect()) for name, stage in corpus_pipeline.STAGES}
    # No text is toxic or a leak; four have no letter; of 1 and the two rows of 6 the first stays, and of 5 and 10, which differ in case.
    assert kept["toxicity"] == kept["decontamination"] == kept["bpe_encoding"] == ids
    assert kept["language_id"] == [i for i in ids if i not in (2, 3, 4, 7)]
    assert kept["near_copies"] == [i for i in ids if i not in (6, 10)]


def test_rows_with_null_or_repeated_ids_are_decided_one_by_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    leak = max((r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()), key=len)
    one, two, three, four = ("the %s river runs by the old house near a green %s tree and on to the sea" % (w, w) for w in ("blue", "wide", "slow", "cold"))
    rows = [(None, one), (None, two), (7, three), (7, four), (3, two), (None, one), (None, None), (None, None), (5, ""), (5, ""), (None, leak), (7, leak)]
    odd = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").select(*docs.columns)

    def kept(stage):
        return sorted(((r["doc_id"], r["text"]) for r in stage(spark, odd, small).collect()), key=repr)

    near = [(None, one), (3, two), (7, three), (7, four), (None, None), (None, None), (5, ""), (5, ""), (7, leak)]
    assert kept(corpus_pipeline.drop_near_copies) == sorted(near, key=repr)
    assert kept(corpus_pipeline.remove_leaks) == sorted([r for r in rows if r[1] != leak], key=repr)
    found = kept(corpus_pipeline.keep_identified)
    assert found == sorted([r for r in rows if r[1]], key=repr)
