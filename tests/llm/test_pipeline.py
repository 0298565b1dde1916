import random

import corpus_pipeline
import sentencepiece
from sitesift.llm import near_dedup, pieces

from .test_llm import prose


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(20)
    texts = [prose(rng, rng.randint(30, 120)) for _ in range(30)]
    near = texts[0].split()
    near[-1] = "changed"
    rows = [*texts, " ".join(near), texts[1], "1234 !!", None]
    df = spark.createDataFrame([(i, t, "en" if t else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, counts = df, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append({r.doc_id for r in docs.collect()})
    assert counts[0] == set(range(32)) and counts[1] == set(range(30)) and counts[2] == set(range(30)) and counts[3] <= counts[2]
    words = sum(len(t.split()) for t in texts)
    mixed = docs.collect()
    assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * words) < 0.05 * words
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids) for r in out) == sorted((r.doc_id, sp.encode(r.text)) for r in mixed)


def test_near_copies_from_four_fifths_go(spark):
    rng = random.Random(21)
    texts = [prose(rng, 60) for _ in range(6)]
    for text in texts[:3]:
        edited = text.split()
        edited[30] = "changed"  # 51 of 61 shingles in common
        texts.append(" ".join(edited))
    edited = texts[3].split()
    edited[20] = edited[40] = "changed"  # 46 of 66
    texts.append(" ".join(edited))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.deduplicated(spark, df, "").collect()) == [0, 1, 2, 3, 4, 5, 9]
    assert near_dedup.near_duplicates(df).filter("kept").count() == len(texts)


def test_passages_of_over_fifty_words_go(spark):
    rng = random.Random(22)
    alone = [prose(rng, 40) for _ in range(6)]
    long, short, tiny = " ".join(prose(rng, 200).split()[:51]), " ".join(prose(rng, 200).split()[:50]), " ".join(rng.choice("abcdefghij") for _ in range(51))
    assert max(len(long.encode()), len(short.encode())) < 400 and len(tiny) == 101
    texts = [f"x{i} {alone[i]} {(long, short, tiny)[i // 2]} y{i}" for i in range(6)]
    texts[1] = texts[1].replace(" ", "\n")
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, df, "").collect()}
    want = {i: f"x{i} {alone[i]} y{i}" for i in (0, 4, 5)} | {1: f"x1 {alone[1]} y1".replace(" ", "\n"), 2: texts[2], 3: texts[3]}
    assert got == want


def test_stages_on_empty_tables_and_odd_rows(spark, tmp_path):
    schema = "score int, doc_id long, text string, lang string, source string, ids string, row int"
    rows = [(1, None, "the cat sat on the mat and the dog", "en", None, "a", 2), (1, None, "the cat sat on the mat and the dog", "en", None, "a", 2), (2, 7, None, None, "s", None, None), (3, 8, "", "en", "s", "b", 1), (4, 9, "word " * 30_000, "en", "t", "c", 3)]
    for n, data in enumerate(([], rows)):
        docs = spark.createDataFrame(data, schema)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert docs.columns == schema.replace(" int", "").replace(" long", "").replace(" string", "").split(", "), name
            else:
                assert docs.columns[:2] == ["score", "doc_id"] and len(docs.columns) == 8
            docs.write.parquet(f"{tmp_path}/{n}{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}{name}")
        assert docs.count() == 0 if not data else docs.count() > 0
