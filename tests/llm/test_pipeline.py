import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from kappaloom.llm import kneser_ney, mixing, simhash
from kappaloom.operators import components
from kappaloom.sources.shared import staged_at

from .test_near import joined_by_similarity


def corpus():
    rng = random.Random(8)
    words = ["of", "the", "as", "in", "word", "another", "threshold", "nothing", "stone", "river", "winter", "morning"]

    def text(n):
        out = [rng.choice(words) for _ in range(n)]
        return out[0].capitalize() + " " + " ".join(out[1:]) + "."

    rows = [(i, text(rng.randrange(20, 60)), "en", f"s{min(i % 5, 2)}") for i in range(80)]
    rows += [(200 + i, rows[i][1], "en", "s0") for i in range(6)]
    rows += [(300, "JUNK!! " * 40, "en", "s1"), (301, None, "en", "s1"), (302, "on and on and on " * 3 + "$$$ " * 40, None, None)]
    return [(*r, len(r[1] or "")) for r in rows]


def test_pipeline_equals_its_parts_by_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(300, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    good = [tuple(r) for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()]
    verdicts = {r.doc_id: r.keep for r in kneser_ney.judge(docs, labels).collect()}
    assert sorted(good) == sorted(r for r in rows if verdicts[r[0]])
    assert not verdicts[300] and not verdicts[301] and not verdicts[302]

    first = joined_by_similarity([(r[0], r[1]) for r in good])
    single = sorted(r for r in good if r[0] in first)
    frame = spark.createDataFrame(good, docs.schema)
    found = corpus_pipeline.near_dedup(spark, frame, str(tmp_path))
    assert found.columns == docs.columns and sorted(map(tuple, found.collect())) == single

    frame = spark.createDataFrame(single, docs.schema)
    mixed = corpus_pipeline.mix(spark, frame, str(tmp_path))
    times = {}
    for r in mixing.mixture(frame).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert mixed.columns == docs.columns
    assert sorted(map(tuple, mixed.collect())) == sorted(r for r in single for _ in range(times.get(r[0], 0)))

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for r in single:
        ids = library.encode(r[1], add_special_tokens=False).ids
        expected += [(r[0], len(ids), ids)] * times.get(r[0], 0)
    assert sorted((r.doc_id, r.n_tokens, list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(expected)


def test_small_tables_are_made_once(spark, tmp_path, monkeypatch):
    """The driver keeps every plan's stages and tasks for a while: what is known is not computed again, and what is done is given up."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    written, given_up = [], []
    for module in (kneser_ney, simhash, components):
        monkeypatch.setattr(module, "staged_at", lambda df, label: written.append(label) or staged_at(df, label))
        monkeypatch.setattr(module, "staged", lambda df, label: written.append(label) or staged_at(df, label)[0], raising=False)
    for module in (kneser_ney, simhash):
        monkeypatch.setattr(module, "forget", lambda s: given_up.append(len(written)), raising=False)
    corpus_pipeline.quality(spark, docs, str(tmp_path)).count()
    assert written.count("by-language") == 2 and given_up
    written.clear()
    given_up.clear()
    corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).count()
    assert "near-pairs" not in written and written.count("shingle-sets") == 2 and len(given_up) == 4


def test_stages_are_named():
    assert len(corpus_pipeline.STAGES) == 4 and all(callable(f) for _, f in corpus_pipeline.STAGES)
