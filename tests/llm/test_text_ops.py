import glob
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.orc as orc
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftlog.llm import bpe, common, host_rules, langid, line_dedup, packing, quality_mil, simhash_trie, token_store, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    "", None, "  \n\t ", "a<|endoftext|>b  <|startoftext|> <|endoftext", "ΣΑΣ ς İI", "it's DON'T we'll 're ''s", "x\x1fy\x1cz", "½ ²³ ١٢ 12a", "日本語テキスト ééé é", "a b　c\x85d",
    "'" * 50, "😀👍🏽 test", "a" * 3000, "abcd" * 60, "\x00\x01 ​ zero", "double  blanks   here \n\n x", " lead", "trail ", "same text", "same text", "one two three four five six " * 4000,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None) for i, t in enumerate(ODD)]
    rows += [(None, "no id", "en", "s1", 3), (None, None, None, None, None), (18, "same text", "en", "s0", 9)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path("word_bpe_49k.json"))


def test_bpe_is_the_library(spark, odd, library):
    got = bpe.round_trip(odd).collect()
    assert len(got) == odd.count()
    texts = [r["text"] for r in odd.collect()]
    want = []
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)


def test_bpe_columns_and_decoding(spark, odd, library):
    df = odd.where("text IS NOT NULL").withColumn("ids2", F.lit(1))
    coded = bpe.decode(bpe.encode(df, out="tokens"), "tokens", "again")
    assert coded.columns == [*df.columns, "tokens", "again"]
    for r in coded.collect():
        assert r["tokens"] == library.encode(r["text"], add_special_tokens=False).ids
        assert r["again"] == library.decode(r["tokens"], skip_special_tokens=False)


def test_segment_tree_merges_leftmost_lowest_first():
    rng = random.Random(5)
    for _ in range(300):
        ranks, made = {}, 100
        for rank in range(30):
            pair = (rng.randrange(4 + rank), rng.randrange(4 + rank))
            if pair not in ranks:
                ranks[pair] = (len(ranks), made)
                made += 1
        symbols = [rng.randrange(4) for _ in range(rng.randrange(1, 40))]
        plain = list(symbols)
        while True:
            best = min(((ranks[p][0], i) for i, p in enumerate(zip(plain, plain[1:])) if p in ranks), default=None)
            if best is None:
                break
            i = best[1]
            plain[i : i + 2] = [ranks[plain[i], plain[i + 1]][1]]
        assert bpe.merge_symbols(symbols, ranks) == plain
        size = 64
        words = np.full((1, size + 1), -1, np.int64)
        words[0, : len(symbols)] = symbols
        merged = bpe.merge_forest(words, np.array([len(symbols)]), bpe.PairTable(ranks))[0]
        assert [x for x in merged.tolist() if x >= 0] == plain


def test_token_store(spark, odd, empty, library, tmp_path):
    path = str(tmp_path / "store")
    rows = odd.where("doc_id IS NOT NULL").withColumn("part", F.lit("clash"))
    got = sorted(token_store.store_digest(rows, path).collect(), key=lambda r: (r["doc_id"], r["start"]))
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    start = 0
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == rows.count()
    found = token_store.lookup(spark, path, [5])
    assert found.first()["ids"] == library.encode(texts[5], add_special_tokens=False).ids + [2]
    assert "EqualTo(doc_id,5)" in found._jdf.queryExecution().toString()
    assert sum(orc.ORCFile(f).nrows for f in glob.glob(path + "/*.orc")) == len(got)
    assert token_store.store_digest(empty, str(tmp_path / "none")).count() == 0
    assert token_store.store_digest(odd, str(tmp_path / "nulls")).count() == odd.count()


def check_packing(rows, texts, capacity, coder):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for doc, text in texts.items():
        ids = coder.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids"] == bytes(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / total


def test_packing(spark, odd, empty):
    coder = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    rows = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).coalesce(1)
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert check_packing(packing.pack(rows).collect(), texts, 1024, coder) < 0.05
    check_packing(packing.pack(rows, capacity=64, tail=4).collect(), texts, 64, coder)
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), (F.col("id") % 90).cast("int")).alias("text"))
    texts = {r["doc_id"]: r["text"] for r in many.collect()}
    assert check_packing(packing.pack(many.coalesce(1)).collect(), texts, 1024, coder) < 0.04
    assert packing.pack(empty).count() == 0
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.pack(rows, ids=False).collect()}
    assert crc == {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in packing.pack(rows).collect()}


def test_cuts():
    for n in range(1, 5000):
        c = packing.cuts(n)
        assert sum(c) == n and all(x == 1024 or x < 1024 and (packing.power(x) or x == c[-1]) for x in c)


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {n: root(n) for n in nodes}


def test_fingerprints(odd):
    for t in ODD:
        assert simhash_trie.fingerprint(t or "") == brute_simhash(t)
    long = "one two three four five six " * 4000
    assert simhash_trie.fingerprint(long, block=100) == brute_simhash(long)


@pytest.mark.parametrize("depth", [0, 1, 5])
def test_trie_self_join(spark, depth, monkeypatch):
    rng = random.Random(depth)
    values = {rng.getrandbits(64) for _ in range(300)}
    for v in list(values)[:150]:
        for _ in range(3):
            values.add(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) * rng.randrange(2))
    values |= {0, 1, 3, 2**64 - 1}
    linked = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2]
    monkeypatch.setattr(simhash_trie, "SUBTRIE", max(1, len(values) >> depth) if depth else 1 << 30)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    df = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    found = simhash_trie.links(df, len(values)).collect()
    want, got = groups(signed.values(), [(signed[a], signed[b]) for a, b in linked]), groups(signed.values(), [(r["a"], r["b"]) for r in found])
    assert want == got
    assert len(linked) > 100


def test_trie_pairs_are_all_pairs():
    rng = random.Random(1)
    a = np.unique(np.array([rng.getrandbits(64) & 0xF0F0F00000000000 for _ in range(200)], np.uint64))
    got = {(i, j) for x, y in simhash_trie.trie_pairs(a, a, 0, 2, True) for i, j in zip(x.tolist(), y.tolist())}
    assert got == {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= 2}


def test_near_duplicates(spark, odd, empty):
    got = simhash_trie.digest(simhash_trie.near_duplicates(odd.withColumn("fp", F.lit(1)).withColumn("component", F.lit(2)))).collect()
    rows = [(r["doc_id"], brute_simhash(r["text"])) for r in odd.collect()]
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{f:016x}" for _, f in rows)
    prints = {f for _, f in rows}
    part = groups(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
    first = {}
    for i, f in rows:
        if i is not None:
            first[part[f]] = min(first.get(part[f], i), i)
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted((str(i), str(first.get(part[f]))) for i, f in rows)
    assert simhash_trie.near_duplicates(empty).count() == 0


def test_host_rules(spark, odd, empty):
    words = "the of a b c d e f g h".split()
    rng = random.Random(2)
    good = [" ".join(rng.choice(words) + str(rng.randrange(1000)) for _ in range(60)) + "\nx\nx\n" for _ in range(40)]
    rows = [(i, t, "bad" if i < 20 else "good") for i, t in enumerate(good)] + [(100 + i, "too short $", "bad") for i in range(60)] + [(200, "x y z x y z " * 20, "good"), (201, good[0], None), (None, good[1], "good")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rows", F.lit(1))
    got = {r["doc_id"]: r for r in host_rules.apply_rules(df).collect()}
    assert got[100]["n_symbols"] == 1 and got[100]["base_failed"] and not got[100]["kept"]
    assert not got[0]["base_failed"] and not got[0]["kept"]  # its host fails three times in four
    assert got[20]["kept"] and got[201]["kept"] and got[None]["kept"]
    assert got[20]["n_dup_lines"] == 1
    assert got[200]["n_repeat_words"] == 120 and got[200]["base_failed"]
    assert host_rules.apply_rules(empty).count() == 0
    assert host_rules.apply_rules(odd).count() == odd.count()


def test_repeated_words():
    def brute(words):
        seen = {}
        for i in range(len(words) - 2):
            seen.setdefault(tuple(words[i : i + 3]), []).append(i)
        return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})

    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(30))]
        assert host_rules.repeated_words(words) == brute(words)


def test_lines(spark, empty):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40))) for _ in range(120)]
    for base in lines[:60]:
        words = base.split()
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        lines.append(" ".join(words) + "!")
    lines += ["", "  ", "Short", "short.", "| |", "end"]
    docs = [(i if i else None, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    docs += [(90, None), (91, ""), (92, docs[3][1]), (92, docs[3][1]), (93, docs[3][1]), (94, "\n".join(["Same line of six words here"] * 400))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, k string, dk int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns
    want = brute_lines(docs)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted((str(i), str(t)) for i, t in want)
    assert sum(a != b for a, b in zip(docs, want)) > 20
    assert line_dedup.dedup_lines(empty).count() == 0


def brute_lines(docs):
    def norm(line):
        return tuple(w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", line.lower()) if w)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    places = {}
    for i, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            if norm(line):
                # rows of one id and text are one; null ids come first
                key = (i is not None, i or 0, p)
                places.setdefault(norm(line), set()).add(key)
    classes = list(places)
    sims = {}
    for c in classes:
        if len(c) >= 5:
            hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(c)]
            sims[c] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    linked = []
    for n, a in enumerate(classes):
        for b in classes[n + 1 :]:
            if a in sims and b in sims and (sims[a] ^ sims[b]).bit_count() <= 3:
                x, y = " ".join(a), " ".join(b)
                if distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                    linked.append((n, classes.index(b)))
    part = groups(range(len(classes)), linked)
    head = {}
    for n, c in enumerate(classes):
        head[part[n]] = min([head.get(part[n], (True, 1 << 60, 0)), *places[c]])
    number = {c: n for n, c in enumerate(classes)}
    out = []
    for i, t in docs:
        if t is None:
            out.append((i, t))
            continue
        kept = [line for p, line in enumerate(t.split("\n")) if not norm(line) or head[part[number[norm(line)]]] == (i is not None, i or 0, p)]
        out.append((i, "\n".join(kept)))
    return out


def brute_sim(features):
    """Bits set in more than half of the hashes, which Spark makes."""
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in features) > len(features))


def test_sketches_of_lines(spark):
    texts = ["one two three four five six seven eight nine", "kurz", " ".join(f"w{n % 400}" for n in range(1000)), "a b c d e f", "東京都に行く", "!!", ""]
    df = spark.createDataFrame([(1, "\n".join(texts))], "doc_id long, text string")
    got = {(r["pos"], r["kind"]): r for r in line_dedup.sketched(line_dedup.lines_of(df)).collect()}
    assert sorted(got) == [(0, 0), (1, 1), (2, 0), (3, 0), (3, 1), (4, 1)]
    for (pos, kind), r in got.items():
        line = texts[pos]
        features = sorted(set(line.split())) if kind == 0 else sorted({"\x01" + f" {line} "[k : k + 2] for k in range(len(line) + 1)})
        hashed = [x[0] & (1 << 64) - 1 for x in spark.createDataFrame([(f,) for f in features], "f string").select(F.xxhash64("f")).collect()]
        assert r["sim"] & (1 << 64) - 1 == brute_sim(hashed), (pos, kind)


def test_recall_by_edit_similarity_alone(spark):
    """Groups of lines against brute force that knows nothing of candidates."""
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect() if r["text"]]
    names = sorted({n for r in docs for line in r["text"].split("\n") if (n := regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", line.lower()).strip())}, key=lambda n: (len(n), n))
    pairs = []
    counts = np.array([np.bincount([ord(c) % 64 for c in n], minlength=64) for n in names])
    for i, n in enumerate(names):
        for j in range(i + 1, len(names)):
            if len(names[j]) > len(n) / 0.8 + 1e-9:
                break
            gap = counts[j] - counts[i]
            if max(gap[gap > 0].sum(), -gap[gap < 0].sum()) <= int(0.2 * len(names[j]) + 1e-9):
                pairs.append((i, j))
    table = spark.createDataFrame([(i, j, names[i], names[j]) for i, j in pairs], "i int, j int, a string, b string")
    true = table.where("levenshtein(a, b) <= floor(0.2 * greatest(length(a), length(b)) + 1e-9)").select("i", "j").collect()
    classes = common.written(line_dedup.sketched(line_dedup.lines_of(spark.createDataFrame(docs))), "recall")
    at = {r["line"]: r["id"] for r in line_dedup.texts_at(classes.select("id", "d1", "d2", "pos").distinct(), spark.createDataFrame(docs)).collect()}
    parts = {r[0]: r[1] for r in common.connected_components(line_dedup.line_links(classes, spark.createDataFrame(docs), True)).collect()}
    together = sum(parts.get(at[names[r["i"]]]) is not None and parts.get(at[names[r["i"]]]) == parts.get(at[names[r["j"]]]) for r in true)
    assert len(true) > 30 and together >= 0.9 * len(true)


def test_line_dedup_is_native(spark, odd):
    plan = line_dedup.dedup_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def labelled(sf="sf0.01"):
    import duckdb

    root = f"/root/testdata/{sf}"
    return duckdb.sql(f"SELECT doc_id, text, lang, quality, toxic FROM '{root}/documents.parquet' LEFT JOIN '{root}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_accuracy():
    rows = labelled()
    model = langid.fit([r[1] for r in rows if fold(r[0], 4) != 2], [r[2] for r in rows if fold(r[0], 4) != 2])
    held = [r for r in rows if fold(r[0], 4) == 2]
    found, score, sets = langid.predict([r[1] for r in held], model)
    assert np.mean([a == r[2] for a, r in zip(found, held)]) > 0.98
    assert all(0 <= s <= 1 for s in score)
    by = {lang: [r[1] for r in rows if r[2] == lang and 2000 < len(r[1]) < 6000 and "|" not in r[1]][:2] for lang in ("en", "de")}
    mixed = by["en"][0][:1800] + "\n" + by["de"][0][:900]
    found, score, sets = langid.predict([mixed, "", "12 !?", "x" * 200_000], model)
    assert found[:3] == ["en", "und", "und"] and set(sets[0]) == {"en", "de"} and 0.5 < score[0] < 0.85 and score[1] == score[2] == 0


def test_languages(spark, odd, empty):
    got = langid.languages(odd.withColumn("lang_score", F.lit(1)))
    assert got.count() == odd.count()
    assert {r["lang_pred"] for r in got.collect()} == {"en", "und"}
    assert langid.languages(empty).count() == 0
    unknown = langid.languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)}
    kept = langid.keep_identified(odd.withColumn("lang_pred", F.lit("mine")))
    assert kept.columns == [*odd.columns, "lang_pred"] and {r["lang_pred"] for r in kept.collect()} == {"mine"}
    assert None not in {r["text"] for r in kept.collect()} and "same text" in {r["text"] for r in kept.collect()}


def test_toxicity_accuracy():
    rows = [r for r in labelled("sf0.1") if r[4] is not None]
    train, held = [r for r in rows if fold(r[0], 5)], [r for r in rows if not fold(r[0], 5)]
    model = toxicity.fit([r[1] for r in train], np.array([r[4] for r in train]))
    p = toxicity.score_texts([r[1] for r in held], model)
    y = np.array([r[4] for r in held])
    assert ((p >= 0.5) == y).mean() > 0.95 and (p >= 0.5)[y == 0].mean() < 0.02


def test_quality_accuracy():
    rows = [r for r in labelled() if r[3] is not None]
    train, held = [r for r in rows if fold(r[0], 3) != 1], [r for r in rows if fold(r[0], 3) == 1]
    net = quality_mil.fit([r[1] for r in train], np.array([r[3] for r in train]))
    p, y = quality_mil.score_texts([r[1] for r in held], net), np.array([r[3] for r in held])
    assert ((p >= 0.5) == y).mean() > 0.97


def test_attention_gradients():
    texts, labels = ["abc def " * 80 + "$$$ %%%" * 40, "plain words here and there " * 30, "", "x\ny\nz"], np.array([0, 1, 1, 0])
    net = quality_mil.fit(texts, labels, epochs=1, batch=4, rate=0.0)
    x, first = quality_mil.passages(quality_mil.encode_texts(texts))
    loss = lambda n: -np.sum(np.where(labels == 1, np.log(quality_mil.forward(x, first, n)["y"]), np.log(1 - quality_mil.forward(x, first, n)["y"])))
    before = loss(net)
    trained = quality_mil.fit(texts, labels, epochs=200, batch=4)
    assert loss(trained) < 0.1 * before
    a = quality_mil.forward(x, first, trained)["a"]
    assert np.allclose(np.add.reduceat(a, first), 1)


def test_classifiers_without_labels(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (quality_mil.quality, toxicity.toxicity):
        assert f(odd, labels).count() == odd.count()
        assert f(empty, labels).count() == 0
        one = spark.createDataFrame([(i, 0, 0) for i in range(20)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
        assert {r["predicted"] for r in f(odd, one).collect()} == {0}
    assert toxicity.drop_toxic(odd.withColumn("score", F.lit("s")), labels).columns == [*odd.columns, "score"]


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 5001 + i) for i in range(300)]
    df = spark.createDataFrame([*pairs, (7, 7), (None, 3), (3, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected_components(df).collect()}
    want = groups({n for p in pairs if p[0] != p[1] for n in p}, [p for p in pairs if p[0] != p[1]])
    assert got == want
    assert common.connected_components(df.limit(0)).count() == 0


def test_hot_key_join(spark):
    left = spark.createDataFrame([("h", i) for i in range(500)] + [(f"k{i % 50}", i) for i in range(100)] + [(None, 1)], "k string, v int")
    right = left.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    got = common.hot_key_join(left, right, "k", F.col("n"), left.count(), 0.01)
    assert got.count() == left.count()
    assert {(r["k"], r["n"]) for r in got.select("k", "n").distinct().collect()} == {("h", 500), (None, None), *((f"k{i}", 2) for i in range(50))}

