import gc

import corpus_pipeline
from prismloom.llm import language, simhash, tokens
from prismloom.llm.common import table
from prismloom.llm.registry import VOCABULARY


def test_stages(spark, small, tmp_path):
    docs = table(spark, small, "documents")
    first = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == first
        if name in ("language_id", "near_dedup"):
            assert docs.subtract(before).isEmpty() and docs.count() <= before.count()
        if name == "personal_data":
            assert docs.count() == before.count()
    automaton = tokens.compiled(tokens.read_vocabulary(VOCABULARY))
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(automaton.decode(bytes(r.token_ids)) == texts[r.doc_id] for r in docs.collect())


def test_driver_keeps_no_automaton(spark, odd_docs):
    vocabulary = tokens.read_vocabulary(VOCABULARY)
    made = tokens.encode(odd_docs, vocabulary)
    gc.collect()
    assert not any(isinstance(x, tokens.MergeAutomaton) for x in gc.get_objects())
    assert tokens.broadcast(spark, vocabulary) is tokens.broadcast(spark, vocabulary) and made.where("n_tokens > 0").count() > 0


def test_odd_documents(spark, odd_docs, no_docs):
    """Nulls in every column, empty and very long texts, ties, repeated rows, an empty table and clashing names, through every stage."""
    for docs in (odd_docs, no_docs):
        columns, first = docs.columns, docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == columns, name
        assert docs.count() <= 2 * first.count()
        clashing = first.withColumn("token_ids", first["key"]).withColumn("row", first["key"])
        last = corpus_pipeline.STAGES[-1][1](spark, clashing, "")
        assert sorted(last.columns) == sorted({*columns, "row", "token_ids", "n_tokens"} - {"text"})
        rows, texts = last.collect(), first.collect()
        automaton = tokens.compiled(tokens.read_vocabulary(VOCABULARY))
        assert sorted(automaton.decode(bytes(r.token_ids)) for r in rows) == sorted(r.text or "" for r in texts)
        assert all(len(r.token_ids) == 4 * r.n_tokens for r in rows)


def test_every_stage_alone_on_odd_documents(spark, odd_docs):
    """What each stage's docstring says of nulls, empty texts, repeated rows and ties."""
    stages = dict(corpus_pipeline.STAGES)
    before = [(r.doc_id, r.text) for r in odd_docs.collect()]
    kept = [(r.doc_id, r.text) for r in stages["language_id"](spark, odd_docs, "").collect()]
    assert kept and all(any(c.isalpha() for c in t or "") for _, t in kept) and set(kept) <= set(before)
    masked = [(r.doc_id, r.text, r.n_chars) for r in stages["personal_data"](spark, odd_docs, "").collect()]
    assert len(masked) == len(before) and all(n == (None if t is None else len(t)) for _, t, n in masked)
    assert {d for d, t, _ in masked if t and "[email]" in t} == {8}
    mixed = [(r.doc_id, r.text) for r in stages["mixing"](spark, odd_docs, "").collect()]
    assert all((t or "").strip(" \t\n\r\x0b\x0c") for _, t in mixed) and all(mixed.count(x) <= 2 * before.count(x) for x in set(mixed))


def test_columns_named_like_those_of_the_stages_stay(spark):
    names = ["__id", "__hash", "__own_id", "__own_hash", "___own_id", "__lang_pred", "__score", "FP", "Text_Hash", "component_id"]
    texts = ["the cat sat on the mat and the dog lay by the door " * 3, "the cat sat on the mat and the dog lay by the door " * 3, "der hund lag an der tür und die katze sass auf der matte " * 3]
    rows = [(k, t, "de" if k == 2 else "en", *[f"{n} {k}" for n in names]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    for kept in (simhash.one_of_each(docs), language.accepted(docs)):
        assert kept.columns == docs.columns
        assert {tuple(r) for r in kept.collect()} <= set(rows)
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {0, 2}
