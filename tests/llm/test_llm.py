import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitesift.llm import chat_format, fingerprint, language_id, mixing, near_dedup, pieces, suffix_dedup, toxicity, url_filter, vector_search
from sitesift.llm.common import remainder

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, schema=DOC):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], schema)


WORDS = "the of and to in that was his he it with is for as had you not be her on at by which have or from this him but all she they were my are".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "ed", "ing"]) for _ in range(n))


# ---- 1


def test_language_network_learns_and_handles_odd_texts(spark):
    rng = random.Random(1)
    make = {"aa": lambda: " ".join(rng.choice(["tha", "wer", "ing"]) for _ in range(60)), "bb": lambda: " ".join(rng.choice(["ößü", "sch", "ung"]) for _ in range(60))}
    rows = [(i, make[lang](), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, remainder("doc_id", 4) != 2, epochs=6)
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, "123 !!", "x"), (3, "THA WER ING " * 20_000, "x"), (3, "sch", None)], "doc_id long, text string, lang string")
    got = language_id.identify(odd, model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "aa", "bb"] and all(0 <= r.score <= 1 for r in got)
    held = language_id.identify(df.filter(remainder("doc_id", 4) == 2), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) == 1
    assert {r.lang_pred for r in language_id.identify(df, language_id.fit(df.limit(0), F.lit(True))).collect()} == {"und"}
    assert language_id.kept_languages(odd, model).columns == odd.columns and language_id.kept_languages(odd, model).count() == 2


def test_network_equals_a_naive_convolution():
    rng = np.random.default_rng(30)
    model = language_id.Model(["a", "b", "c"], [rng.normal(0, 1, (w, 256, 4)) for w in (2, 3)], [rng.normal(0, 1, 4) for _ in range(2)], rng.normal(0, 1, (8, 3)), rng.normal(0, 1, 3), 16)

    def naive(window):
        pooled = []
        for table, bias in zip(model.tables, model.biases, strict=True):
            n = len(window) - len(table) + 1
            pooled += [max(0.0, max(sum(table[k][window[i + k]][f] for k in range(len(table))) for i in range(n)) + bias[f]) for f in range(4)]
        z = [sum(h * model.weights[j][c] for j, h in enumerate(pooled)) + model.offset[c] for c in range(3)]
        e = [np.exp(v - max(z)) for v in z]
        return np.array(e) / sum(e)

    texts = ["", "aé", "Hello, world! 42", "x" * 17, "the quick brown fox jumps over it " * 3, "ÀÉß ûñ 日本語 abc"]
    got_lang, got_score = language_id.predict(model, pa.array(texts), np.array([any(c.isalpha() for c in t) for t in texts]))
    for text, lang, score in zip(texts, got_lang, got_score, strict=True):
        raw = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in "".join(c.lower() if c.isascii() or "\u00c0" <= c <= "\u00de" and c != "\u00d7" else c for c in text).encode())
        cuts = [raw[i : i + 16].ljust(16) for i in range(0, max(len(raw) - 2, 1), 14)] if raw else []
        total = sum((naive(c) * (sum(b != 32 for b in c) + 1e-3) for c in cuts), np.zeros(3))
        if not raw:
            assert (lang, score) == ("und", 0)
        else:
            assert lang == "abc"[int(total.argmax())] and score == pytest.approx(total.max() / total.sum())


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "you idiot", 5, "q", True, [1], 7, "r", 3)], "doc_id long, text string, score int, lang_pred string, letters boolean, ids array<int>, n_tokens int, round_trip string, c0 int")
    model = language_id.train(["das ist gut"] * 3 + ["this is good"] * 3, ["de"] * 3 + ["en"] * 3, epochs=1)
    assert language_id.identify(df, model).columns == ["doc_id", "text", "letters", "ids", "n_tokens", "round_trip", "c0", "lang_pred", "score"]
    out = toxicity.score_texts(df, toxicity.Grammar({"idiot": 4.0}, (0.5, 0.5, 0.0), -2.0))
    assert out.columns == ["doc_id", "text", "lang_pred", "letters", "ids", "n_tokens", "round_trip", "c0", "score", "predicted"] and out.first().c0 == 3
    coded = pieces.encode(df)
    assert coded.columns == ["doc_id", "score", "lang_pred", "letters", "c0", "ids", "n_tokens", "round_trip"] and coded.first().round_trip is True
    assert pieces.decode(coded.withColumn("text", F.lit(1))).first().text == "you idiot"
    again = fingerprint.edited_fingerprints(df.withColumn("fingerprint", F.lit(1)).withColumn("__range", F.lit(1)))
    assert again.count() == 1 and mixing.mix(df.withColumn("source", F.lit("s")).withColumn("size", F.lit(1)).withColumn("cell", F.lit("x"))).count() == 1
    vectors = spark.createDataFrame([(i, [float(i)], i, "x") for i in range(3)], "vec_id long, embedding array<double>, score int, block string")
    assert vector_search.top_k(vectors, F.lit(True)).count() == 6


def test_empty_tables_of_all(spark):
    none = docs(spark, ["x"]).limit(0)
    assert language_id.identify(none, None).count() == 0 and toxicity.score_texts(none, toxicity.Grammar({}, (1.0, 0.5, 0.0), -3.0)).count() == 0 and pieces.encode(none).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.format_conversations(turns)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(pages, url_filter.rules_frame(spark, [url_filter.Rule("com", "/", "block")])).count() == 0


def test_rows_with_null_and_equal_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f")] * 3 + [(4, "a b c d e f")] * 2 + [(None, None)], "doc_id long, text string")
    marked = fingerprint.edited_fingerprints(df).collect()
    assert len(marked) == 6 and {r.n_chars for r in marked} == {0, 11} and {r.doc_id for r in marked} == {None, 4}
    mixed = mixing.mix(df.withColumn("source", F.lit(None).cast("string"))).collect()
    assert sorted(r["size"] for r in mixed) == [0, 6, 6, 6, 6, 6] and abs(sum(r.taken for r in mixed) - 45) <= 8
    vectors = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (None, [9.0]), (2, [3.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id) for r in vector_search.top_k(vectors, F.lit(True)).collect()) == [(1, 2), (1, 2), (2, 1), (2, 1)]


# ---- 2


def naive_fingerprint(raw):
    """One byte after the other, with whole numbers."""
    whole = (1 << 64) - 1
    byte, base = fingerprint._BYTE.tolist(), fingerprint._BASE

    def poly(part):
        total, power = 0, 1
        for b in part:
            total, power = (total + byte[b] * power) & whole, (power * base) & whole
        return total

    def finish(h):
        h ^= h >> 32
        h = (h * 0xD6E8FEB86659FD93) & whole
        h ^= h >> 32
        h = (h * 0xD6E8FEB86659FD93) & whole
        return h ^ (h >> 32)

    rolled = [((poly(raw[max(0, i - 6) : i + 1]) * 0xD6E8FEB86659FD93) & whole) >> 24 for i in range(len(raw))]
    block = 4
    while block * 64 < len(raw):
        block *= 2
    while block > 4 and sum(r % block == block - 1 for r in rolled) < 31:
        block //= 2

    def signature(size):
        out, start = "", 0
        for i, r in enumerate(rolled):
            if r % size == size - 1 and len(out) < 63:
                out, start = out + chr(fingerprint._CODE[finish(poly(raw[start : i + 1])) >> 58]), i + 1
        return out + (chr(fingerprint._CODE[finish(poly(raw[start:])) >> 58]) if start < len(raw) else "")

    return f"{block}:{signature(block)}:{signature(2 * block)}"


def test_fingerprints_equal_naive_ones():
    rng = random.Random(31)
    texts = ["", "a", "é", "x" * 700, "ab" * 400, *(prose(rng, n) for n in (1, 3, 20, 60, 300, 700)), *("".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(20))]
    assert fingerprint.fingerprints(pa.array(texts)) == [naive_fingerprint(t.encode()) for t in texts]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_edit_distances():
    rng = random.Random(2)
    a, b = (["".join(rng.choice("ABc") for _ in range(rng.randint(0, 64))) for _ in range(100)] for _ in range(2))
    pack = lambda rows: (np.array([list(r.ljust(64).encode()) for r in rows], np.uint8), np.array([len(r) for r in rows]))
    assert fingerprint.distances(*pack(a), *pack(b)).tolist() == [distance(x, y) for x, y in zip(a, b, strict=True)]


def test_fingerprints_of_a_batch_are_those_of_single_texts():
    rng = random.Random(3)
    texts = ["", "a", "x" * 5000, *(prose(rng, n) for n in (3, 50, 900))]
    assert fingerprint.fingerprints(pa.array(texts)) == [fingerprint.fingerprints(pa.array([t]))[0] for t in texts]
    edited = texts[-1][:2000] + "CHANGED" + texts[-1][2000:]
    a, b, c = fingerprint.fingerprints(pa.array([texts[-1], edited, prose(rng, 900)]))
    near, far = fingerprint.likeness([a, a], [b, c])
    assert near > 0.9 > 0.4 > far


def test_edited_texts(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(40)] + [None, "é" * 9]
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].near_next == pytest.approx(fingerprint.likeness([got[i].fingerprint], [got[(i - 1) % len(texts)].fingerprint])[0])
    assert fingerprint.edited_fingerprints(docs(spark, ["abc"])).first().near_next == 1.0
    assert fingerprint.edited_fingerprints(docs(spark, ["abc"]).limit(0)).count() == 0


# ---- 3


def test_toxicity_grammar():
    g = toxicity.Grammar({"idiot": 4.0}, (0.5, 0.5, 0.0), -2.0)
    plain, aimed, negated, told = (g.clause(t) for t in ("an idiot came", "you idiot", "he is not idiot", "she said idiot"))
    assert aimed > plain > negated and aimed > told
    assert g.clause("i will kill you") > 0 == g.clause("kill time")
    assert g.score(None) == g.score("") == g.score("clean text") < g.score("You IDIOT!") and g.score("x. you idiotic! y") > g.score("y")


def test_toxicity_prefilter_misses_no_clause():
    g = toxicity.Grammar({"idiot": 3.0, "straß": 2.0}, (1.0, 0.5, 0.0), -3.0)
    for before in ("¡", "«", "“", "—", "\u00a0", "'", "’", "d'", "l'", "L’", "¿", "_", "7", "İİ. İ "):
        text = f"Bien. {before}Idiota, you aren't; {before}straße and I will {before}kill you!"
        scores = [s for c in toxicity._CLAUSE_END.split(text) if (s := g.clause(c)) > 0]
        assert len(scores) == 2, before
        assert g.features(text) == pytest.approx((max(scores), np.log1p(sum(scores)), np.log1p(len(scores)))), before
    assert [t[0] for t in toxicity._TOKEN.finditer("isn't l'idiot DON'T")] == ["isn't", "l", "idiot", "DON'T"]


def naive_clause(grammar, text):
    """Token by token with counters, without tables."""
    tokens = [m[0].lower() for m in toxicity._TOKEN.finditer(text)]
    has = lambda words, lo, hi: any(t in words for t in tokens[max(lo, 0) : hi])
    total = 0.0
    for i, t in enumerate(tokens):
        if t in toxicity._QUOTES:
            continue
        weight = max((w for s, w in grammar.stems.items() if t.startswith(s)), default=0.0)
        if t in toxicity.HARMS and has(toxicity.ANNOUNCERS, i - toxicity.REACH, i + 1):
            weight += toxicity.THREAT
        if has(toxicity.NEGATIONS, i - toxicity.NEAR, i + 1):
            weight *= toxicity.NEGATED
        if has(toxicity.REPORTS, 0, i + 1) or sum(x in toxicity._QUOTES for x in tokens[:i]) % 2:
            weight *= toxicity.REPORTED
        if has(toxicity.TARGETS, i - toxicity.REACH, i + 1 + toxicity.REACH):
            weight *= toxicity.TARGETED
        total += weight
    return total


def test_composed_transducers_equal_single_ones_and_the_naive_walk():
    rng, g = random.Random(32), toxicity.Grammar({"idiot": 4.0, "idio": 1.0, "scum": 2.5}, (0.5, 0.5, 0.0), -2.0)
    words = ["you", "idiot", "idiotic", "scum", "will", "kill", "not", "said", '"', "tree", "house", "of", "and", "red"]
    for _ in range(400):
        classes = [rng.randrange(7) for _ in range(rng.randint(0, 25))]
        single = [p.run(classes) for p in toxicity.PARTS]
        state = 0
        for i, at in enumerate(toxicity.COMPOSED.run(classes)):
            parts = [(p, s[i]) for p, s in zip(toxicity.PARTS, single, strict=True)]
            assert toxicity.COMPOSED.adds[at] == sum(p.adds[s] for p, s in parts) and toxicity.COMPOSED.aim[at] == max(p.aim[s] for p, s in parts)
            assert toxicity.COMPOSED.factor[at] == pytest.approx(np.prod([p.factor[s] for p, s in parts]))
            state = toxicity.COMPOSED.step[state][classes[i]]
            assert state == at
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        assert g.clause(text) == pytest.approx(naive_clause(g, text)), text


def test_toxicity_of_a_very_long_text():
    g = toxicity.Grammar({"idiot": 4.0}, (0.5, 0.5, 0.0), -2.0)
    one, many = "you idiot, " * 20_000, "you idiot. " * 20_000
    assert g.features(one)[2] == pytest.approx(np.log1p(1)) and g.features(many)[2] == pytest.approx(np.log1p(20_000))


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(rng, 40) + (f" you {rng.choice(['florbish', 'florbex'])} " if bad else " ") + prose(rng, 10)))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    grammar = toxicity.fit(d, y, remainder("doc_id", 3) != 1)
    got = toxicity.score_texts(d.filter(remainder("doc_id", 3) == 1), grammar).join(y, "doc_id").collect()
    assert all(r.predicted == r.toxic for r in got)
    assert toxicity.score_texts(d, toxicity.fit(d, y.limit(0), F.lit(True))).filter("predicted = 1").count() == 0


# ---- 4


def test_pieces_equal_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    sp, held, rng = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.pieces(), random.Random(6)
    texts = ["", " ", "  a", "a\n b\tc", "▁x", "日本語😀 x", "   日本 ", "x" * 300 + "*" * 90, "1234 don't </s>"] + ["".join(rng.choice("abehint ThE.,é1\n") for _ in range(50)) for _ in range(400)]
    assert [i.tolist() for i in held.encode(texts)] == [sp.encode(t) for t in texts]
    assert [held.decode(i).decode() for i in held.encode(texts)] == [t.replace("▁", " ") for t in texts]


def test_pieces_frame(spark):
    out = pieces.encode(spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "the cat", 7)], "doc_id long, text string, ids int").withColumnRenamed("ids", "extra"))
    got = {(r.extra): r for r in out.collect()}
    assert got[5].ids is None and got[6].ids == [] and got[7].round_trip and got[7].n_tokens == len(got[7].ids)
    assert {r.extra: r.text for r in pieces.decode(out).collect()} == {5: None, 6: "", 7: "the cat"}


# ---- 5


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").translate({i: i + 32 for i in range(65, 91)}).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 85 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [len(s) for s in sets], label


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates_and_hot_groups(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SHARE", block)
    rng = random.Random(7)
    texts = [None, "", "  ", "one two", "ONE two", "one two three"]
    for words in (7, 60, 200):
        base = prose(rng, words).split()
        for k in range(40):  # a group of near copies, most of them unlike each other
            edited = list(base)
            for _ in range(k % 9):
                edited[rng.randrange(len(edited))] = f"w{rng.random()}"
            texts.append(" ".join(edited))
    texts += [prose(rng, 30) for _ in range(20)] + [texts[50]] * 30
    sizes, label = brute_components(texts)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == label
    assert all(got[i].kept == (label[i] == i) for i in got)
    kept = near_dedup.keep_one(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label)) and kept.columns == docs(spark, texts).columns


def test_recall_near_the_threshold(spark):
    """Planted pairs with similarities from 0.80 to 0.90, short texts included: all that link are found, and no other."""
    rng, texts = random.Random(24), []
    for i in range(400):
        words = prose(rng, rng.choice([12, 30, 60, 150, 400])).split()
        edited, edits = list(words), max(1, round(len(words) * 0.028 * rng.uniform(0.3, 1.2)))
        for at in rng.sample(range(len(words)), edits):
            edited[at] = f"w{i}x{at}"
        if len(words) == 12 or i % 4 == 0:
            edited = words + [f"w{i}"] * rng.randint(1, 2 + len(words) // 5)  # few shingles more
        texts += [" ".join(words), " ".join(edited)]
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    alike = [len(a & b) / len(a | b) for a, b in zip(shingles[::2], shingles[1::2], strict=True)]
    assert sum(0.80 <= x < 0.85 for x in alike) > 20 and sum(0.85 <= x < 0.90 for x in alike) > 20
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    linked = [100 * len(a & b) >= 85 * len(a | b) for a, b in zip(shingles[::2], shingles[1::2], strict=True)]
    assert [got[2 * i + 1] == 2 * i for i in range(400)] == linked


def test_near_duplicates_of_odd_rows(spark):
    rng = random.Random(25)
    same, other = prose(rng, 30_000), prose(rng, 50)
    rows = [(5, same, 1)] * 40 + [(None, same, 1), (None, None, 1), (3, same, 1), (5, other, 1), (9, other, 1), (9, other, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid int").withColumn("band", F.lit("x"))
    got = near_dedup.near_duplicates(df).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sum(r["count"] for r in got) == len(rows) and {(r.doc_id, r.component_id) for r in got if r.doc_id in (3, None)} == {(3, 3), (None, None)}
    assert {r.component_id for r in got if r.doc_id == 9} == {5}
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {3, None}


def test_blocks_find_what_pairs_find():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 40, rng.integers(5, 30)).astype(np.uint64)) for _ in range(60)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (near_dedup.common_counts(sets, dense=10) == want)[~np.eye(60, dtype=bool)].all()


def test_empty_tables(spark):
    none = docs(spark, ["x"]).limit(0)
    assert near_dedup.near_duplicates(none).count() == 0 and suffix_dedup.remove_repeats(none).count() == 0 and mixing.mix(none).count() == 0


# ---- 6


def test_chat_round_trip(spark):
    hard = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", "a\\ <|im_end|> é😀"), (1, 2, "assistant", ""), (1, 3, None, None), (1, 4, "assistant", "\n\n  b"), (None, 0, "user", "x"), (1, 4, "assistant", "\n\n  b")]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1)))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", hard), ("assistant", "a\\ <|im_end|> é😀"), ("assistant", ""), ("", ""), ("assistant", "\n\n  b"), ("assistant", "\n\n  b")]
    assert got[1].loss_text == "a\\ <|im_end|> é😀\n\n  b\n\n  b" and got[None].loss_text == ""
    assert all(c not in chat_format.escape(hard) for c in chat_format.CONTROLS)
    assert len(got[1].ids) == len(got[1].loss)


# ---- 7


def test_apportionment_is_by_highest_quotients():
    rng = random.Random(9)
    for _ in range(30):
        votes, seats = [rng.randint(0, 50) for _ in range(rng.randint(1, 8))], rng.randint(0, 60)
        got = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
            got[best] += 1
        assert mixing.apportion(np.array(votes), seats).tolist() == got


def test_mix(spark):
    rng = random.Random(10)
    texts = [prose(rng, rng.randint(0, 300)) for _ in range(120)] + [None]
    rows = [(i, t, None if i % 10 == 0 else f"s{i % 4}") for i, t in enumerate(texts)] + [(5, texts[5], "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = mixing.mix(df, shard_words=4000).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    want = {s: 2 * sizes[s] if s in full else level * weight[s] for s in order}
    by_size = {sizes[s]: want[s] for s in order}
    assert all(r.target == pytest.approx(by_size[r.source_size]) and 0 <= r.taken <= 2 * r["size"] for r in got) and len(got) == len(rows)
    for size, target in by_size.items():
        assert sum(r.taken for r in got if r.source_size == size) == pytest.approx(target, rel=0.02, abs=40)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(df, shard_words=4000).collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert all(r.taken == sum(r.quota // r.blocks + (mixing.block_hash(r.mark, b) <= r.last_hash) for b in ((r.start + i) // 8 for i in range(r["size"]))) for r in got)
    for mark, blocks, rest in {(r.mark, r.blocks, r.quota % max(r.blocks, 1)) for r in got}:
        picked = sorted(range(blocks), key=lambda b: mixing.block_hash(mark, b))[:rest]
        assert all((mixing.block_hash(mark, b) <= mixing.last_picked(mark, blocks, rest)) == (b in picked) for b in range(blocks))
    seats = {r.mark: (r.source_size, r.quota) for r in got}
    votes = sorted(by_size.items())
    most = [2 * sum(r.blocks for r in {x.mark: x for x in got if x.source_size == size}.values()) for size, _ in votes]
    dealt = mixing.apportion(np.array([v for _, v in votes]), int(sum(want.values()) / 8 + 0.5), np.array(most))
    assert [sum(q for s, q in seats.values() if s == size) for size, _ in votes] == dealt.tolist()
    texts_out = mixing.mixed_texts(df, shard_words=4000)
    assert texts_out.columns == df.columns
    assert sum(len(r.text.split()) for r in texts_out.collect()) == sum(r.taken for r in got)


# ---- 8


def test_url_rules(spark):
    rules = [url_filter.Rule("com", "/en/", "block"), url_filter.Rule("example.com", "/en/7", "allow"), url_filter.Rule("net", "", "block"), url_filter.Rule("", "/x", "block")]
    urls = ["https://A.Example.COM/en/71?x", "https://a.com/en/", "http://xcom/en/", "https://a.net", None, "a.com/en/", "https://a.com/EN/", "https://a.net"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.rules_frame(spark, rules)).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and got[1] == ("a.com", "/en/", "com/en/", "block")
    assert got[2][3] == "allow" and got[3] == got[7] == ("a.net", "", "net", "block") and got[4] == got[5] == ("", "", None, "allow") and got[6][3] == "allow"
    same = spark.createDataFrame([(1, "https://a.net")] * 3 + [(None, None)] * 2, "page_id long, url string")
    assert url_filter.filter_urls(same, url_filter.rules_frame(spark, rules)).count() == 5
    assert url_filter.filter_urls(same, url_filter.rules_frame(spark, rules).limit(0)).filter("verdict = 'allow'").count() == 5


# ---- 9


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (300, 8)).round(2)
    x[100:130] = x[99]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1020, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.top_k(df, F.col("vec_id") % 20 == 0, k=7, block=64, group=4, pivots=5).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    ids = np.arange(300)
    want = vector_search.brute_force(ids, np.floor(64 * x).astype(np.int64), ids % 20 == 0, 7)
    assert got.astype("int64").equals(want.astype("int64"))
    assert vector_search.top_k(df.filter("vec_id in (0, 1)"), F.col("vec_id") == 0).count() == 1
    told = vector_search.top_k(df, F.col("vec_id") % 20 == 0, k=7, block=64, group=4, pivots=5, report=True).collect()
    assert len(told) == len(want) and all(7 <= r.evaluated <= 300 for r in told)
    wide = spark.createDataFrame([(1, [2.0**56]), (2, [2.0]), (3, [-1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        vector_search.top_k(wide, F.col("vec_id") == 2).collect()
    assert vector_search.top_k(df.limit(0), F.lit(True)).count() == 0


def test_bounds_stop_early():
    rng = np.random.default_rng(12)
    c = np.concatenate([rng.integers(-5, 5, (3000, 6)), rng.integers(900, 1000, (50, 6))])
    pivots = vector_search.choose_pivots(c, 8)
    q = c[-3:]
    *_, evaluated = vector_search.search_block(np.array([-1, -2, -3]), q, vector_search.pivot_distances(q, pivots), np.arange(len(c)), c, vector_search.pivot_distances(c, pivots), 10)
    assert all(evaluated < len(c)) and evaluated.sum() > 0
    least = vector_search.starting_scores(np.array([-1, -2, -3]), q, np.arange(len(c)), c, 10)
    far = c[:64]
    *_, skipped = vector_search.search_block(np.array([-1, -2, -3]), q, vector_search.pivot_distances(q, pivots), np.arange(64), far, vector_search.pivot_distances(far, pivots), 10, least=least)
    assert skipped.sum() == 0


# ---- 10


def brute_repeats(raws, length):
    seen = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_interval_expansion_equals_counting():
    rng = random.Random(13)
    for length in (3, 9, 20):
        for _ in range(10):
            segments = list({bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 50))) for _ in range(10)}) + [b"ab" * 25, b"a" * 40]
            seen = {}
            for s in segments:
                for i in range(len(s) - length + 1):
                    seen[s[i : i + length]] = seen.get(s[i : i + length], 0) + 1
            want = [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in segments]
            assert [g.tolist() for g in suffix_dedup.repeated_starts(segments, length)] == want


def brute_passages(texts, words):
    """How many runs of words under repeated strings of `words` words each text has."""
    split, seen = [(t or "").encode().split() for t in texts], {}
    for w in split:
        for i in range(len(w) - words + 1):
            k = tuple(w[i : i + words])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i : i + words])] > 1:
                gone[i : i + words] = True
        out.append(int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()))
    return out


def test_word_strings_equal_counting():
    rng = random.Random(23)
    segments = list({" ".join(rng.choice("abc") for _ in range(rng.randint(1, 40))).encode() for _ in range(12)})
    seen, split = {}, [s.split() for s in segments]
    for w in split:
        for i in range(len(w) - 3):
            seen[tuple(w[i : i + 4])] = seen.get(tuple(w[i : i + 4]), 0) + 1
    assert [g.tolist() for g in suffix_dedup.repeated_starts(segments, 4, words=True)] == [[i for i in range(len(w) - 3) if seen[tuple(w[i : i + 4])] > 1] for w in split]


@pytest.mark.parametrize("block", [3000, 4])
def test_repeats_across_documents(spark, block, monkeypatch):
    rng = random.Random(14)
    passage = prose(rng, 150)
    short = " ".join(passage.split()[20:71])
    texts = [prose(rng, 40) + " " + passage + " " + prose(rng, 30) for _ in range(25)]
    texts += [passage, passage[:400], passage[1:400], "be " * 400, "é" * 900, None, "", prose(rng, 500), prose(rng, 90) + passage[50:460], "x " + short + "\n\n" + short.replace(" ", "\t") + " y", " ".join(short.split()[1:])]
    texts += [texts[0]] * 3
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (block,))
    df = docs(spark, texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages) for r in suffix_dedup.remove_repeats(df).collect()}
    want = brute_repeats([(t or "").encode() for t in texts], 400)
    assert [got[i] for i in range(len(texts))] == [(*w, n) for w, n in zip(want, brute_passages(texts, 51), strict=True)]
    assert all(len(suffix_dedup.remove_repeats(df, passages=None).filter(f"n_removed = {w[1]}").take(1)) == 1 for w in want[:1])
    out = {r.doc_id: r for r in suffix_dedup.without_repeats(df).collect()}
    assert passage not in "".join(r.text or "" for r in out.values()) and len(texts) - 5 in out and all(r.n_chars == len(r.text or "") for r in out.values())


def test_many_equal_rows_with_null_ids(spark):
    text = prose(random.Random(15), 130)
    schema = "doc_id long, text string, spans int, hash string"
    df = spark.createDataFrame([(None, text, 1, "x")] * 5000 + [(None, text + "!", 1, "x"), (0, "other", 1, "x"), (0, None, 1, "x")], schema)
    got = suffix_dedup.remove_repeats(df).groupBy("doc_id", "n_bytes", "n_removed", "n_passages").count().collect()
    n = len(text)
    assert sorted(((r[1], r[2], r[3], r[4]) for r in got)) == [(0, 0, 0, 1), (5, 0, 0, 1), (n, n, 1, 5000), (n + 1, n, 1, 1)]
    left = suffix_dedup.without_repeats(df).collect()
    assert sorted(r.text or "" for r in left) == ["", "!", "other"] and left[0].asDict().keys() == {"doc_id", "text", "spans", "hash"}
