"""The training-data operators against brute force on small fixtures: nulls, empties, ties, repeats, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import common, embeddings, entries, langid, linededup, mixing, neardup, packing, quality, secrets, sharding, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, rid int, n int"
LONG = " ".join(f"w{i}" for i in range(60))
LINE = "a line of more than forty code points, for certain, yes"


def rows():
    texts = [None, "", "one", LONG, LONG, LONG + " tail", "x " + LONG, "\n".join([LINE, "short", LINE.upper() + "  "]), *(f"{LINE}\nown {i}" for i in range(6)), "Password = 'hunter22' AKIA" + "A" * 16 + " " + "0a" * 12, "tok éü " * 30, " ".join(f"long{i % 977}" for i in range(5000)), "\x1c  é\tb\x0bc"]
    out = [(i, t, None if i % 5 == 0 else ("en", "de")[i % 2], None if i % 7 == 0 else f"s{i % 3}", 0, i, "k", 1, 2) for i, t in enumerate(texts)]
    return [*out, (None, LONG, "en", "s1", 0, 1, "k", 1, 2), (3, LONG, "en", "s1", 0, 1, "k", 1, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def low(i):
    return -(2**63) if i is None else i


def test_empty_tables(spark, empty):
    vocabulary = entries.vocabulary()
    for df in (secrets.scanned(empty), langid.labelled(empty, steps=2), linededup.line_report(empty), packing.packed_pieces(empty, vocabulary), neardup.clusters(empty), quality.judged(empty), sharding.sharded(empty), mixing.mixed(empty), substrings.substring_report(empty), mixing.drawn_texts(empty), quality.filtered(empty), linededup.dedup_lines(empty), neardup.kept(empty)):
        assert df.count() == 0
    assert embeddings.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_secrets(docs):
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scanned(docs).collect())
    want = Counter()
    for i, t, *_ in rows():
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        n = Counter(k for _, k, _ in found)
        want[(i, n[0], n[1], n[2], sha(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))))] += 1
    assert got == want


def test_ownership_separates_examples(spark):
    token = "Zx9Qw2Er7Ty4Ui1Op8As5Df"
    df = spark.createDataFrame([(i, f"see {token}", f"s{i}") for i in range(5)] + [(9, "mine Kj3Hg6Fd9Sa2Po5Iu8Yt1", "s1")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.spans, r.n_live, r.n_example) for r in secrets.scanned(df).collect()}
    end = 5 + len("Kj3Hg6Fd9Sa2Po5Iu8Yt1")
    assert got[9] == (f"owned:5:{end}", 1, 0) and got[0] == ("", 0, 1)


def test_lines(docs):
    def key(x):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({i: i + 32 for i in range(65, 91)})

    held = defaultdict(set)
    for i, t, *_ in rows():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(low(i))
    want = Counter()
    for i, t, *_ in rows():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 5 and max(held[key(x)]) != low(i))]
        want[(i, len(lines), len(lines) - len(kept), sha("\n".join(kept)))] += 1
    for bits in (None, 1 << 16):
        assert Counter(map(tuple, linededup.line_report(docs, bits=bits).collect())) == want
    assert sum(k[2] for k in want) > 0


def test_substrings(docs):
    for n in (None, 1, 7):
        got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_report(docs, n=n).collect()}
        brute = substrings.brute_force({low(i): t for i, t, *_ in rows()})
        assert got == {(None if i == -(2**63) else i, *v) for i, v in brute.items()}


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(entries.vocabulary())
    odd = "Áb ç, don't it's İx ΣΣ <|endoftext|> a<|endoftext|>b x y 12ab3, ab12. café!!  q \x1cz --a' ﬁne ABC'S"
    both = docs.select("doc_id", "text").unionAll(docs.sparkSession.createDataFrame([(99, odd)], "doc_id long, text string"))
    found = packing.packed_pieces(both, entries.vocabulary(), window=64).collect()
    ids = defaultdict(list)
    for r in both.collect():
        ids[r.doc_id].append([*t.encode(r.text or "", add_special_tokens=False).ids, 2])
    assert all(any(r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in ids[r.doc_id]) for r in found)
    spans = sorted((r.sequence_id * 64 + r.offset, r.length) for r in found)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert sum(n for _, n in spans) == sum(len(x) for v in ids.values() for x in v)


def test_packed_ids_make_whole_sequences(docs, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "FLUSH", 100)
    t = Tokenizer.from_file(entries.vocabulary())
    found = sorted(packing.packed_ids(docs, entries.vocabulary(), window=64).collect(), key=lambda r: (r.sequence_id, r.offset))
    sequences, own = defaultdict(list), []
    for r in found:
        assert len(r.ids) == r.length and r.offset == len(sequences[r.sequence_id])
        sequences[r.sequence_id] += r.ids
        if r.start == 0:
            own.append([r.doc_id, []])
        assert own[-1][0] == r.doc_id and len(own[-1][1]) == r.start
        own[-1][1] += r.ids
    assert [len(sequences[i]) for i in range(len(sequences) - 1)] == [64] * (len(sequences) - 1)
    want = Counter((r.doc_id, (*t.encode(r.text or "", add_special_tokens=False).ids, 2)) for r in docs.collect())
    assert Counter((i, tuple(x)) for i, x in own) == want


def brute_components(texts, k):
    sets = {i: ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())) for i, t in texts.items() if (w := (t or "").encode().lower().split()) is not None}
    root = {i: i for i in sets}
    for _ in sets:
        for a, x in sets.items():
            for b, y in sets.items():
                if a != b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    return {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}


def test_near_duplicates(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.clusters(docs, k=2).collect() if r.doc_id is not None}
    assert got == brute_components({i: t for i, t, *_ in rows() if i is not None}, 2)
    assert [r.kept for r in neardup.clusters(docs, k=2).where("doc_id is null").collect()] == [True]


def test_near_copies_without_a_hub(spark):
    """Copies that differ from one another by about the limit: chains through leaders, blocks and components."""
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(70):
        w = list(base)
        for j in rng.choice(120, int(rng.integers(2, 11)), replace=False):
            w[j] = f"x{i}.{j}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.clusters(df, k=2).collect()}
    assert got == brute_components(texts, 2)


def test_quality(docs):
    want = Counter()
    for i, t, *_ in rows():
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        n = Counter(tri)
        again = {j + q for j, x in enumerate(tri) if n[x] > 1 for q in range(3)}
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))] += 1
    assert Counter(tuple(r)[:7] for r in quality.judged(docs).collect()) == want
    assert quality.filtered(docs).schema == docs.schema


def test_depleted_documents_go(spark):
    def page(i):
        return (i, "\n".join([" ".join(f"menu{j}" for j in range(50)), f"own{i} words{i}"]), "h")

    df = spark.createDataFrame([page(i) for i in range(30)] + [(99, LONG, "h"), (100, " ".join(f"y{i}" for i in range(60)), None)], "doc_id long, text string, source string")
    assert {r.doc_id for r in quality.judged(df).where("kept").collect()} == {99, 100}


@pytest.mark.parametrize("distinct", ["doc_id", "content"])
def test_lines_over_the_limit_leave_the_kept_texts(spark, distinct):
    """``filtered`` against brute force: verdicts, and texts without the lines that too many documents of a host hold."""
    menu, odd = "Menu  of the\tsite", "  MENU of the site \x0b"
    data = [(i, f"{menu}\nown {' '.join(f'w{i}x{j}' for j in range(55 + i % 3))}\n\n{odd if i % 4 else 'once ' + str(i)}\nlast {i}", "h" if i % 6 else None) for i in range(60)]
    data += [(100 + i, "\n".join([" ".join(f"menu{j}" for j in range(50)), f"own{i}"]), "h") for i in range(30)]
    data += [(200, f"{menu}\n{LONG}", "other"), (201, None, "h"), (202, data[1][1], "h"), (203, f"{menu}\r\n{LONG}\n", "h")]
    data += [(300 + i, "a page of many copies\n" + LONG, "copied") for i in range(25)] + [(None, LONG, "copied"), (2, data[2][1], "h")]

    def key(x):
        return " ".join(WORD.findall(x)).translate({i: i + 32 for i in range(65, 91)})

    docs_of, held = defaultdict(set), defaultdict(set)
    for i, t, h in data:
        told = (t or "") if distinct == "content" or i is None else i
        docs_of[h].add(told)
        for x in (t or "").split("\n"):
            held[h, key(x)].add(told)
    want, removed, depleted = Counter(), 0, 0
    for i, t, h in data:
        over = [bool(key(x)) and len(held[h, key(x)]) > max(20, 0.005 * len(docs_of[h])) for x in (t or "").split("\n")]
        w = WORD.findall(t or "")
        lost = sum(len(WORD.findall(x)) for x, o in zip((t or "").split("\n"), over) if o)
        if len(w) >= 50 and lost > 0.7 * len(w):
            depleted += 1
        elif len(w) >= 50:
            removed += any(over)
            want[(i, "\n".join(x for x, o in zip(t.split("\n"), over) if not o), h)] += 1
    got = quality.filtered(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4), distinct=distinct)
    assert Counter(map(tuple, got.collect())) == want
    assert removed > 40 and depleted == (56 if distinct == "doc_id" else 30)


def test_sharding(docs):
    found = sharding.sharded(docs).collect()
    text = {r[0]: r[1] for r in rows()}
    for r in found:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data)) and r.grown_shard in (r.shard, 16)
    for k in range(16):
        own = sorted(r.slot for r in found if r.shard == k)
        assert own == list(range(len(own)))


def test_growth_moves_rows_into_the_new_shard_only(spark):
    df = sharding.sharded(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    moved = df.where("shard <> grown_shard").groupBy("grown_shard").count().collect()
    assert [r.grown_shard for r in moved] == [16] and 150 < moved[0]["count"] < 330
    assert all(170 < r["count"] < 330 for r in df.groupBy("shard").count().collect())


def test_mixing(docs):
    found = mixing.mixed(docs).collect()
    text = {r[0]: r[1] for r in rows()}
    assert all(r.size == len(WORD.findall(text[r.doc_id] or "")) and 0 <= r.taken <= 3 * r.size for r in found)
    total, target, taken = sum(r.size for r in found), {}, Counter()
    for r in found:
        target[r.source_size] = r.target  # sizes differ between the sources; an id is in two of them
        taken[r.source_size] += r.taken
    assert abs(sum(target.values()) - total) < 1e-6 * total
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 4 for s in target)
    assert sorted(map(tuple, (r[1:] for r in found)), key=str) == sorted(map(tuple, (r[1:] for r in mixing.mixed(docs).collect())), key=str)
    words = sum(len(WORD.findall(r.text)) for r in mixing.drawn_texts(docs).collect())
    assert words == sum(r.taken for r in found)


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((20, 16))
    rows = []
    for i in range(150):
        v = base[i % 20] + rng.standard_normal(16) * rng.choice([0, 0.15, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], [1, 2, None][i % 7 % 3]))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [None, *[1.0] * 15], 1), (203, [float("nan"), *[1.0] * 15], 1), (204, [1.0, 2.0], 1), (205, [2.0, 4.0], 1), (None, rows[0][1], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    able = [(i, np.float64(np.float32(v)), k) for i, v, k in rows if i is not None and k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: {j for j, w, m in able if j != i and k == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93} for i, v, k in able}
    root = {i: i for i in links}
    for _ in links:
        for i, own in links.items():
            root[i] = min([root[i], *(root[j] for j in own)])
    for i, *_ in rows:
        want = (len(links.get(i, ())), root.get(i, i), root.get(i, i) == i) if i is not None else (0, None, True)
        assert got[i] == want, i


def test_language_id(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.labelled(df, per_lang=60, steps=80).join(df.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found) > 100
    odd = langid.labelled(spark.createDataFrame([(1, None, "en"), (2, "123 !!", "en"), (3, "some words here", "en"), (None, "x", None)], "doc_id long, text string, lang string"), steps=2)
    assert {r.doc_id: r.lang_pred for r in odd.collect()} | {3: 0} == {1: "und", 2: "und", 3: 0, None: odd.collect()[3].lang_pred}


def test_every_label_is_learned_from(spark):
    rows = [(i, f"word{i % 70} text", f"l{i % 70:02}") for i in range(1400)]
    sample = langid.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=200)
    assert {k for _, k in sample} == {k for *_, k in rows}


def test_code_switching_is_labelled_by_word(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('en', 'de') and length(text) > 600").limit(60)
    model = langid.fit([(r.text, r.lang) for r in df.collect()], steps=80)
    parts = {r.lang: langid.words_of(r.text)[:40] for r in df.collect()}
    post = langid.Labeller(model)([parts["en"] + parts["de"]])
    names = [model.langs[i] for i in post.argmax(axis=1)]
    assert names[:40].count("en") >= 36 and names[40:].count("de") >= 36


def test_sql(spark):
    from ..oracle import compare, views

    sf = "/root/testdata/sf0.001"
    for name, sql in entries.oracle_sql().items():
        assert compare(entries.queries()[name](spark, sf), views(sf), sql) == "", name


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf).cache()
        assert now.schema == docs.schema
    assert corpus_pipeline.run(spark, sf).agg(F.sum("length")).first()[0] == packing.packed_pieces(now, entries.vocabulary()).agg(F.sum("length")).first()[0]


def test_a_mix_follows_rows_not_where_they_lie(docs):
    def drawn(df):
        return Counter(map(tuple, mixing.drawn_texts(df, block_words=16).collect()))

    assert drawn(docs) == drawn(docs.orderBy(F.col("n_chars"), F.col("doc_id").desc()).coalesce(1)) == drawn(docs.repartition(7, "text"))


def test_the_id_filter_loses_no_id(spark):
    df = spark.range(-3000, 3000).withColumn("text", F.lit("x"))
    for step in (7, 4000, 100_000):
        ids = spark.range(-3000, 3000, step)
        found = {r.id for r in neardup.likely(df, ids).collect()}
        assert {r.id for r in ids.collect()} <= found and len(found) <= 6000 // step + 1 + 400
    assert neardup.likely(df, spark.range(0)).count() == 0


def test_sql_where_something_is_found(spark, tmp_path):
    """op6 and op7 against their SQL on tables that have links, frequent lines, nulls and unusable vectors."""
    from ..oracle import compare, views

    common = "this line stands in many documents of one host and of no other host at all\n"
    docs = []
    for i in range(90):
        own = " ".join(f"w{i}x{j}" for j in range(60 if i % 3 else 12))
        docs.append((i, common * (1 + i % 4) + own if i % 2 else own, None if i % 5 == 0 else f"host{i % 2}"))
    notice = " ".join(f"notice{j}" for j in range(60))  # alone it makes a long text without repeats
    docs += [(200 + i, f"{notice}\nshort and own {i}", "host1") for i in range(30)]
    docs += [(90, None, "host1"), (91, "", None), (92, "a b c a b c\n\n a b c", "host0"), (93, docs[3][1], docs[3][2])]
    vectors = [(i, [float(np.cos(i * 0.2)), float(np.sin(i * 0.2))], i % 2) for i in range(40)]  # chains around the circle
    vectors += [(40, None, 0), (41, [0.0, 0.0], 0), (42, [float("nan"), 1.0], 0), (43, [1.0, None], 1), (44, [1.0, 0.0], None), (45, [1.0, 0.0, 0.0], 0), (46, vectors[6][1], 0)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").toPandas().to_parquet(tmp_path / "documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(str(tmp_path / "e"))
    next((tmp_path / "e").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    con = views(str(tmp_path))
    for name in ("op6_embedding_near_dedup", "op7_quality_rules"):
        assert compare(entries.queries()[name](spark, str(tmp_path)), con, entries.oracle_sql()[name]) == "", name
    op6 = entries.queries()["op6_embedding_near_dedup"](spark, str(tmp_path))
    assert op6.where("not kept").count() > 0 and op6.where("n_links > 1").count() > 0
    op7 = entries.queries()["op7_quality_rules"](spark, str(tmp_path))
    assert op7.where("lost_words > 0").count() > 0 and op7.where("not kept and not base_failed").count() > 0


def brute_ids(data, k):
    """doc_id -> smallest id, where rows of one id are one document that holds all their sets."""
    sets = [(i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}) for i, t in data if (w := (t or "").encode().lower().split())]
    root = {i: i for i, _ in sets}
    for _ in range(len(root)):
        for i, x in sets:
            for j, y in sets:
                if 100 * len(x & y) >= 80 * len(x | y):
                    root[i] = root[j] = min(root[i], root[j])
    return root


@pytest.mark.parametrize("parts", [1, 4, 211])
def test_rows_that_repeat_an_id_join_their_classes(spark, parts):
    other = " ".join(f"o{i}" for i in range(60))
    data = [(1, LONG), (1, other), (2, other + " more"), (3, LONG + " more"), (4, "alone here now"), (4, LONG[:40]), (5, LONG[:40]), (0, "one two three"), (6, "one two three")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(parts)
    got = neardup.clusters(df, k=2).collect()
    want = brute_ids(data, 2)
    assert len(got) == len(data) and {(r.doc_id, r.component_id) for r in got} == set(want.items())
    assert want[2] == want[3] == 1 and want[5] == 4 and want[6] == 0


def test_no_count_of_shards_moves_rows_between_old_ones(spark):
    ids = spark.range(3000).select(F.col("id").alias("key"))
    found = ids.select(*(sharding.place(F.col("key"), sharding.tree(n)).alias(f"n{n}") for n in range(1, 42))).toPandas()
    for n in range(1, 41):
        moved = found[found[f"n{n}"] != found[f"n{n + 1}"]]
        assert set(moved[f"n{n + 1}"]) <= {n} and found[f"n{n}"].max() < n
        assert 0.5 < len(moved) * (n + 1) / 3000 < 1.6


def test_a_weight_moves_rows_within_its_own_shard_only(spark):
    old, new = sharding.tree(16), sharding.tree(16)
    new["region1"]["rack2"]["9"] = 3.0
    new["region0"]["rack1"]["4"] = 0.0
    got = spark.range(6000).select(sharding.place(F.col("id"), old).alias("a"), sharding.place(F.col("id"), new).alias("b")).where("a <> b").distinct().collect()
    assert all(r.b == 9 or r.a == 4 for r in got) and any(r.b == 9 for r in got) and any(r.a == 4 and r.b != 9 for r in got)


def test_spans_take_time_that_grows_with_the_text():
    import time

    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefABCDEF0123456789XYZxyzQRSTUV"))
    text = "\n".join(f"token = {''.join(rng.choice(letters, 30))} {''.join(rng.choice(letters, 40))}" for _ in range(12_000))
    took = []
    for t in (text[: len(text) // 4], text):
        began = time.perf_counter()
        found = secrets.spans(t)
        took.append(time.perf_counter() - began)
    base = [(s, e) for s, k, e, _ in found if k < 3]
    own = [(s, e) for s, k, e, _ in found if k == 3]
    want = [(m.start(), m.end()) for m in secrets.OPAQUE.finditer(text[:60_000]) if secrets.opaque(m[0]) and not any(s < m.end() and m.start() < e for s, e in base[:3000])]
    assert own[: len(want) - 5] == want[:-5] and len(want) > 500
    assert took[1] < 12 * took[0] + 0.2


def test_ownership_against_brute_force(spark):
    rng = np.random.default_rng(6)
    value = ["".join(rng.choice(list("abcdefghKLMNOP0123456789"), 24)) for _ in range(12)]
    data = [(i % 40 if i % 11 else None, " ".join(value[j] for j in rng.choice(12, 3)), None if i % 9 == 0 else f"s{rng.integers(3)}") for i in range(90)]
    got = {r.hash: (r.n_repos, r.n_owners, r.n_rows) for r in secrets.ownership(secrets.candidates(spark.createDataFrame(data, "doc_id long, text string, source string"))).collect()}
    want = {}
    for v in value:
        if secrets.opaque(v):
            held = [(d, s) for d, t, s in data if v in t]
            times = sum(t.split().count(v) for _, t, _ in data)
            want[secrets.xxhash.xxh3_128_digest(v.encode())] = (len({d for d, _ in held}), len({s for _, s in held}), times)
    assert got == want and len(want) > 5


def random_model(rng, langs=3):
    words = ["one", "due", "trois", "vier", "cinco", "sechs", "sept", "otto", "nine"]
    return words, langid.Model([f"l{i}" for i in range(langs)], 0.3 * rng.standard_normal((langid.BUCKETS, langs)), {words[0]: 1}, rng.standard_normal((langs, langs)), rng.standard_normal((langs, langs)), rng.standard_normal(langs))


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(8)
    words, model = random_model(rng)
    texts = [[words[i] for i in rng.integers(0, 9, n)] for n in (1, 2, 3, 5, 6)]
    found = np.split(langid.Labeller(model)(texts), np.cumsum([len(t) for t in texts])[:-1])
    for t, post in zip(texts, found):
        e = np.log(model.emissions(t))
        want = np.zeros((len(t), 3))
        for path in product(range(3), repeat=len(t)):
            s = model.start[path[0]] + sum(model.transitions[a, b] for a, b in zip(path, path[1:])) + sum(e[i, k] for i, k in enumerate(path))
            for i, k in enumerate(path):
                want[i, k] += np.exp(s)
        assert np.allclose(post, want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_segments_of_a_long_text_agree_with_the_whole():
    words, model = random_model(np.random.default_rng(9))
    texts = [[words[i % 9] for i in range(n)] for n in (0, 7, 100, 230)]
    whole, cut = (langid.Labeller(model).labelled(texts, s) for s in (1000, 7))
    assert np.allclose(whole[0], cut[0], atol=1e-4)
    assert all(np.array_equal(a, c) and np.array_equal(b, d) for (a, b), (c, d) in zip(whole[1], cut[1]))


def test_switched_words_are_in_the_output(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('en', 'de') and text is not null")
    parts = {r.lang: " ".join(langid.words_of(r.text)[:40]) for r in df.where("length(text) > 600").collect()}
    both = df.select("doc_id", "text", "lang").unionAll(spark.createDataFrame([(-1, f"{parts['en']} {parts['de']}", None)], df.select("doc_id", "text", "lang").schema))
    r = langid.labelled(both, per_lang=60, steps=80).where("doc_id = -1").collect()[0]
    told = [x.lang for x in r.labels for _ in range(x.end - x.start)]
    assert len(told) == r.n_words == 80 and [x.start for x in r.labels] == [0, *(x.end for x in r.labels[:-1])]
    assert told[:40].count("en") >= 36 and told[40:].count("de") >= 36


def test_vectors_that_repeat_an_id_stand_for_themselves(spark):
    a, b, c = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1], [0.0, 1.0, 0.12]
    rows = [(1, a, 1), (1, b, 1), (2, c, 1), (3, a, 1), (4, [-x for x in a], 1), (0, a, 2), (5, [1e200, 0.0, 1e199], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit("x")).withColumn("id", F.lit(1))
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.clusters(df).collect())
    assert got == Counter([(1, 2, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 0, 4, True), (0, 0, 0, True), (5, 2, 1, False)])


def brute_mix(rows, block_words):
    """rid -> words taken: (rid, source, size, h as an unsigned number, doc_id, content) rows."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    size = {s: sum(r[2] for r in by[s]) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target = sum(size.values()), {}
    while True:  # those above their cap stop there, the rest share what is left
        left, share = total - sum(target.values()), sum(weight[s] for s in names if s not in target)
        over = [s for s in names if s not in target and left * weight[s] / share > 3 * size[s]]
        if not over:
            target |= {s: left * weight[s] / share for s in names if s not in target}
            break
        target |= {s: 3 * size[s] for s in over}
    block = {s: max(1, min(max(block_words, -(-total // mixing.MOST_SLOTS)), size[s] // 256)) for s in names}
    n_blocks = {s: -(-size[s] // block[s]) for s in names}
    slots = {s: min(int(target[s] * n_blocks[s] / size[s] + 0.5), 3 * n_blocks[s]) if size[s] else 0 for s in names}
    n, ends, uses, rank = sum(slots.values()), np.cumsum([slots[s] for s in names]), Counter(), Counter()
    for j in range(n):
        s = names[int(np.searchsorted(ends, (j * mixing.GOLDEN % 2**32) * n >> 32, "right"))]
        if rank[s] < 3 * n_blocks[s]:
            uses[s, rank[s] % n_blocks[s]] += 1
        rank[s] += 1
    taken = Counter()
    for s in names:
        at = 0
        for r in sorted((r for r in by[s] if r[2]), key=lambda r: (r[3], r[4] is not None, r[4] or 0, r[5])):
            for w in range(at, at + r[2]):
                taken[r[0]] += uses[s, w // block[s]]
            at += r[2]
    return taken, target


def mixed_rows(df):
    """What ``brute_mix`` takes, with rid the place in the list."""
    told = df.select("doc_id", "source", "text", F.xxhash64("text").alias("content")).withColumn("h", F.xxhash64("doc_id", "content", F.lit(7)))
    return [(i, r.source, len(WORD.findall(r.text or "")), r.h % 2**64, r.doc_id, r.content) for i, r in enumerate(told.collect())]


def test_mixing_against_brute_force(spark):
    rng = np.random.default_rng(12)
    data = [(i, " ".join(f"w{j}" for j in range(int(rng.integers(0, 90)))) or None, [None, "a", "b", "c", "d"][int(rng.integers(5)) if i % 3 else 1]) for i in range(240)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5).cache()
    for words in (8, 1024):
        taken, target = brute_mix(rows := mixed_rows(df), words)
        got = {r.doc_id: r for r in mixing.mixed(df, words).collect()}
        assert {i: r.taken for i, r in got.items()} == {r[4]: taken[r[0]] for r in rows}
        assert all(abs(got[r[4]].target - target[r[1]]) < 1e-6 for r in rows)
        assert all(abs(sum(got[r[4]].taken for r in rows if r[1] == s) - target[s]) <= 0.06 * target[s] + 4 for s in target)


def pipeline_rows():
    rng = np.random.default_rng(21)
    own = lambda n: " ".join(f"{rng.choice(['al', 'be', 'ga'])}{rng.integers(10**6)}" for _ in range(n))
    line = "This very line stands in documents of every source, so it is common"
    out = [own(60 + i) + ("\n" + line.upper() if i % 2 else "\n" + line + "  ") + "\n" + own(8) for i in range(40)]
    menu = "Menu of one site with links to all the other pages of it"
    out += [f"{menu}\n{own(70)}" for _ in range(25)]
    out += [out[0]] * 3 + [out[1] + " more", "x " + out[1], own(300), own(12), None, "", own(5) * 40]
    sources = [("s1", "s2", None)[i % 3] for i in range(40)] + ["site"] * 25 + ["s1"] * (len(out) - 65)
    return [(i if i != 70 else None, t, "en", s, len(t or "")) for i, (t, s) in enumerate(zip(out, sources))]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage's rows, from what the stage before it gave."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame(pipeline_rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    stages, docs, after = dict(corpus_pipeline.STAGES), spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after.append([tuple(r) for r in docs.collect()])
        assert i == len(stages) - 1 or docs.columns == names

    def key(x):
        return " ".join(WORD.findall(x)).translate({i: i + 32 for i in range(65, 91)})

    # 1: base rules, lines over the limit, depleted documents
    data, held, of_host = pipeline_rows(), defaultdict(set), defaultdict(set)
    for _, t, _, s, _ in data:
        of_host[s].add(t or "")
        for x in (t or "").split("\n"):
            held[s, key(x)].add(t or "")
    want = Counter()
    for i, t, *rest in data:
        w = WORD.findall(t or "")
        tri = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        again = {j + q for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for q in range(3)}
        lines = [(x, bool(key(x)) and len(held[rest[1], key(x)]) > max(20, 0.005 * len(of_host[rest[1]]))) for x in (t or "").split("\n")]
        lost = sum(len(WORD.findall(x)) for x, o in lines if o)
        if len(w) >= 50 and len(again) <= 0.5 * len(w) and lost <= 0.7 * len(w):
            want[(i, "\n".join(x for x, o in lines if not o), *rest)] += 1
    assert Counter(after[0]) == want and any("Menu" not in (r[1] or "") and r[3] == "site" for r in after[0])
    # 2: lines
    strip = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({i: i + 32 for i in range(65, 91)})
    held = defaultdict(set)
    for i, t, *_ in after[0]:
        for x in t.split("\n"):
            if len(strip(x)) >= 40:
                held[strip(x)].add((i is not None, i if i is not None else t))
    want = Counter()
    for i, t, *rest in after[0]:
        own = (i is not None, i if i is not None else t)
        want[(i, "\n".join(x for x in t.split("\n") if not (len(held[strip(x)]) >= 5 and max(held[strip(x)]) != own)), *rest)] += 1
    assert Counter(after[1]) == want and after[1] != after[0]
    # 3: near duplicates
    comp = brute_components({i: t for i, t, *_ in after[1] if i is not None}, 5)
    assert Counter(after[2]) == Counter(r for r in after[1] if r[0] is None or comp[r[0]][2]) and len(after[2]) < len(after[1])
    # 4: the mix: whole copies, and a first part where a block ends
    before = spark.read.parquet(str(tmp_path / "2"))
    told = before.select(*names, F.xxhash64(*names).alias("content")).withColumn("h", F.xxhash64("doc_id", "content", F.lit(7))).collect()
    taken, _ = brute_mix([(i, r.source, len(WORD.findall(r.text)), r.h % 2**64, r.doc_id, r.content) for i, r in enumerate(told)], 1024)
    want = Counter()
    for i, r in enumerate(told):
        words = list(WORD.finditer(r.text))
        times, rest = divmod(taken[i], len(words))
        parts = [r.text] * times + ([r.text[: words[rest - 1].end()]] if rest else [])
        want.update((r.doc_id, x, r.lang, r.source, len(x) if x != r.text else len(r.text)) for x in parts)
    assert Counter(after[3]) == want
    # 5: every id of every document, in its place
    t = Tokenizer.from_file(entries.vocabulary())
    ids = Counter((i, (*t.encode(x, add_special_tokens=False).ids, 2)) for i, x, *_ in after[3])
    found, now = Counter(), None
    for r in sorted((r.asDict() for r in docs.collect()), key=lambda r: (r["sequence_id"], r["offset"])):
        if r["start"] == 0:
            now = (r["doc_id"], [])
        now[1].extend(r["ids"])
        if len(now[1]) == r["doc_tokens"]:
            found[now[0], tuple(now[1])] += 1
    assert found == ids


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """Chains of alike texts of many sizes, through many blocks."""
    monkeypatch.setattr(neardup, "WIDE", 4)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(200)]
    texts = {i: " ".join(base[: int(rng.integers(40, 200))] + [f"x{i}.{j}" for j in range(int(rng.integers(0, 9)))]) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.clusters(df, k=2).collect()}
    assert got == brute_components(texts, 2)


def test_a_very_long_text_is_treated_whole(spark):
    """A text of some megabytes, hashed in several parts, with copies; every operator sees its end."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a, b in zip(rng.choice(["straße", "Haus", "river", "ño"], 400_000), rng.integers(0, 60_000, 400_000))]
    long = " ".join(words[:200_000]) + "\n" + LINE + " end\n" + " ".join(words[200_000:]) + "\npassword = hunter2222"
    assert len(long.encode()) > 1.5 * common.STEP
    data = [(1, long, "en", "a"), (2, long + " more", "en", "a"), (3, "few words here", "de", "b"), *((10 + i, f"{LINE} end\n{i} w{i}", "de", "b") for i in range(5)), (None, long, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(3)
    n = len(WORD.findall(long))
    r = {x.doc_id: x for x in secrets.scanned(df).collect()}[1]
    assert r.n_assign == 1 and r.spans.split(",")[-1] == f"assign:{len(long) - 21}:{len(long)}"
    r = {x.doc_id: x for x in langid.labelled(df, steps=5).collect()}[1]
    assert r.n_words == n == r.labels[-1].end
    r = {x.doc_id: x for x in linededup.line_report(df).collect()}
    assert (r[1].n_lines, r[1].n_dropped, r[14].n_dropped) == (4, 1, 0)
    r = [x for x in packing.packed_pieces(df, entries.vocabulary()).collect() if x.doc_id == 1]
    assert r[0].doc_tokens == 1 + len(Tokenizer.from_file(entries.vocabulary()).encode(long, add_special_tokens=False).ids) == sum(x.length for x in r)
    r = {x.doc_id: x for x in neardup.clusters(df, k=2).collect()}
    low = long.translate({i: i + 32 for i in range(65, 91)}).encode().split()
    assert r[1].n_shingles == len(set(zip(low, low[1:]))) and r[2].component_id == 1 and r[None].kept
    r = {x.doc_id: x for x in quality.judged(df).collect()}[1]
    tri = Counter(zip(*(WORD.findall(long)[j:] for j in range(3))))
    assert (r.n_words, r.word_chars) == (n, len(re.sub(r"[\x20\x09-\x0D]", "", long))) and r.n_repeat_words <= 3 * sum(v for v in tri.values() if v > 1)
    r = {x.doc_id: x for x in sharding.sharded(df).collect()}[1]
    assert (r.size, r.text_crc32) == (len(long.encode()) + 1, zlib.crc32(long.encode()))
    assert {x.doc_id: x.size for x in mixing.mixed(df).collect()}[1] == n
    r = {x.doc_id: x for x in substrings.substring_report(df).collect()}
    assert (r[2].n_words, r[2].n_removed, r[None].n_removed) == (n + 1, n, 0)


def test_null_ids_do_not_meet(spark):
    """A third of the rows without an id: they are treated one by one, and no operator fails."""
    data = [(None if i % 3 == 0 else i, f"{LINE} of many\nown {i} " + " ".join(f"w{i}x{j}" for j in range(60)), "en", f"s{i % 2}") for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(7)
    r = linededup.line_report(df).collect()
    assert sorted((x.doc_id or 0, x.n_dropped) for x in r) == sorted((d or 0, int(d != 299)) for d, *_ in data)
    brute = substrings.brute_force({(-1 if d is None else d): t for d, t, *_ in data if d is not None})
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substrings.substring_report(df.where("doc_id is not null")).collect()}
    assert got == {d: v[:2] for d, v in brute.items()}
    assert all(x.n_removed == 0 for x in substrings.substring_report(df).where("doc_id is null").collect())
    assert neardup.clusters(df).where("doc_id is null and kept").count() == 100
    assert neardup.kept(df).count() == 300
    for f in (secrets.scanned, quality.judged, sharding.sharded, mixing.mixed, lambda x: langid.labelled(x, steps=3)):
        assert f(df).count() == 300


def test_rows_that_repeat_an_id_are_one_document(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, f"{a} {b}"), (1, a)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.substring_report(df).collect())
    assert got == Counter([(1, 30, 0), (1, 30, 0), (1, 30, 0), (2, 60, 60)])


def test_languages_of_the_common_rows(docs):
    r = langid.labelled(docs, steps=5).collect()
    assert len(r) == len(rows()) and {x.lang_pred for x in r} <= {"en", "de", "und"}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows() if i is not None}
    assert all(x.held_out == held.get(x.doc_id, False) and (x.lang_pred == "und") == (not x.labels) for x in r)


def test_documents_of_a_host_by_id(spark):
    """One page under many ids: one document by content, many by id."""
    page = "\n".join(" ".join(f"p{i}x{j}" for j in range(12)) for i in range(6))
    df = spark.createDataFrame([(i, page, "h") for i in range(30)], "doc_id long, text string, source string")
    assert quality.judged(df, distinct="content").where("kept").count() == 30
    assert quality.judged(df).where("kept or lost_words <> 72").count() == 0


def test_packed_integers_come_back():
    for kind in ("<u4", "<u8"):
        for values in ([], [7], [0, 2**31, 5, 2**32 - 1]):
            assert common.unpacked(common.packed(np.array(values, np.uint64), kind), kind).tolist() == values


def test_hot_joins_lose_and_add_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    left = spark.range(200).select("id", F.when(F.col("id") < 120, 7).otherwise(F.col("id") % 11).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k <> 5").withColumn("v", F.col("k") * 10)
    got = common.hot_join(left, right, ["k"], "n", 200, "id")
    want = left.join(right.drop("n"), "k")
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_one_value_in_every_row(spark, monkeypatch):
    """One secret, line, near copy and vector in all rows, with keys that count as hot from 20 rows on."""
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    token = "Zx9Qw2Er7Ty4Ui1Op8As5Df"
    base = " ".join(f"b{i}" for i in range(100))
    data = [(i, f"{LINE}\nsee {token} {base} own{i % 40}", f"s{i % 2}") for i in range(160)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(6)
    r = secrets.scanned(df).collect()
    assert len(r) == 160 and all((x.spans, x.n_live, x.n_example) == ("", 0, 1) for x in r)
    r = secrets.scanned(df.withColumn("source", F.lit("one"))).collect()
    assert all(x.n_live == 1 and x.spans.startswith("owned:") for x in r)
    assert all(x.component_id == 0 for x in neardup.clusters(df, k=2).collect()) and neardup.kept(df, k=2).count() == 1
    r = {x.doc_id: x for x in quality.judged(df).collect()}
    assert len(r) == 160 and all(x.lost_words == len(LINE.split()) for x in r.values())
    assert sorted((x.doc_id, x.n_dropped) for x in linededup.line_report(df).collect()) == [(i, int(i < 159)) for i in range(160)]
    v = spark.range(160).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") % 4).cast("double") / 1000).alias("embedding"), F.lit(1).alias("label"))
    assert all((x.n_links, x.component_id) == (159, 0) for x in embeddings.clusters(v).collect())
