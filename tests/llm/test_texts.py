"""Operators that run Python on the executors, on the edge-case corpus."""

import random
import zlib

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planegrid.llm import flac, packing, token_counts, toxicity
from planegrid.llm.jaccard import near_components
from planegrid.llm.licenses import LICENCES, licence_words, scan, word_idf
from planegrid.llm.substrings import without_repeats
from planegrid.llm.words import Texts, window_hashes


def canon(rows):
    return sorted(map(tuple, rows), key=str)


def test_words_of_a_column():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n\t\x0b\x1cß") for _ in range(rng.choice([0, 1, 5, 50]))) for _ in range(300)] + [None, "", " "]
    t = Texts(pa.array(texts).slice(2))
    own = [[bytes(t.data[s:e]).decode() for s, e in zip(t.starts[a:z], t.ends[a:z])] for a, z in zip(t.first, t.first[1:])]
    assert own == [plain.words(x) for x in texts[2:]]
    flat = [w for x in own for w in x]
    names = {}
    for i, h in enumerate(window_hashes(t.hashes(), 3)):
        assert names.setdefault(tuple(flat[i : i + 3]), h) == h
    assert len(set(names.values())) == len(names)


def test_substring_dedup(docs, rows):
    got = without_repeats(docs, joined=True).select("doc_id", "text", "n_words", "n_removed").collect()
    want = []
    for (d, *_), (w, keep) in zip(rows, plain.repeats([r[1] for r in rows])):
        want.append((d, " ".join(x for x, k in zip(w, keep) if k), len(w), keep.count(False)))
    assert canon(got) == canon(want)


def test_substring_dedup_keeps_blanks(docs, rows):
    got = {r["doc_id"]: r["text"] for r in without_repeats(docs).where("doc_id IN (20, 100, 110, 115)").collect()}
    by = {r[0]: r[1] for r in rows}
    assert got[110] is None and got[115] == by[115]
    assert "\n" in (got[100] or "\n")


def test_substring_dedup_other_window_and_nothing(spark, none):
    texts = ["a b c d e f g h i j k l m", "x a b c d e f g h i j k l y", "q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = canon(without_repeats(df, window=12, joined=True).select("doc_id", "text").collect())
    assert got == [(0, "m"), (1, "x y"), (2, "q")]
    assert without_repeats(none).count() == 0


def test_loops_and_branches(spark):
    """Texts that repeat themselves, and passages that share parts."""
    rng = random.Random(4)
    v = [f"w{i}" for i in range(400)]
    a, b, c = ([rng.choice(v) for _ in range(70)] for _ in range(3))
    texts = [" ".join(x) for x in (a * 5, a + b, b + c, a[30:] + c[:50], b[10:60], ["same"] * 300, c)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in without_repeats(df, joined=True).collect()}
    for i, (w, keep) in enumerate(plain.repeats(texts)):
        assert got[i] == (" ".join(x for x, k in zip(w, keep) if k), keep.count(False))


def test_near_components(docs, rows):
    got = near_components(docs).collect()
    comp = plain.components([(r[0], r[1]) for r in rows])
    want = []
    for i, (d, t, *_) in enumerate(rows):
        s = plain.shingles(t)
        want.append((d, len(s), comp[i] if s else d))
    assert canon(got) == canon(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_components_at_the_border(spark, seed):
    """A family whose members link or not by a shingle or two, short texts among them."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(150):
        w = list(base[: rng.choice([3, 4, 5, 6, 12, 40, 40, 40])])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(300)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == plain.components(rows)


def test_near_components_of_nothing(none):
    assert near_components(none).count() == 0


def test_packing_round_trip(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = [*((d, t) for d, t, *_ in rows), (900, "<|endoftext|> one <|endoftext|>"), (901, "y" * 260_000)]
    more = spark.createDataFrame(own[-2:], "doc_id long, text string")
    got = packing.packed_documents(docs.select("doc_id", "text").union(more)).collect()
    want = []
    for d, t in own:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        n = len(ids)
        cuts = [0, *range(n % 2048 or min(n, 2048), n + 1, 2048)]
        want += [(d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert canon((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == canon(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_packing_of_nothing(none):
    assert packing.packed_documents(none).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_dominance_reduction_keeps_the_optimum(seed):
    """Against the least number of bins, found by search over small instances."""
    rng = random.Random(seed)
    capacity = 20
    items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
    counts = {a: items.count(a) for a in items}
    fixed, left = packing.reduce_by_dominance(dict(counts), capacity)
    rest = [a for a, n in left.items() for _ in range(n)]
    assert sum(fixed.values()) + best(sorted(rest, reverse=True), capacity) == best(items, capacity)
    packed = packing.best_fit(left, capacity)
    assert sum(k * m for p, m in packed.items() for _, k in p) == len(rest)
    assert all(sum(a * k for a, k in p) <= capacity for p in packed)


def best(items, capacity):
    least = len(items)

    def place(i, bins):
        nonlocal least
        if len(bins) >= least:
            return
        if i == len(items):
            least = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity:
                bins[j] += items[i]
                place(i + 1, bins)
                bins[j] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return least


def test_both_encoders_give_the_same_ids():
    """Every assigned code point in several contexts, special strings, blanks, and words of over 200,000 characters."""
    import public_tokenizers as p
    from tokenizers import Tokenizer

    at = p.path("byte_bpe_50k")
    e, tok = packing._Encoder(f"{at}.json", f"{at}.tiktoken", p.PATTERN), Tokenizer.from_file(f"{at}.json")
    rng = random.Random(4)
    texts = ["", " ", "  a  b\n\n c", "don't 'S  über 12345 ###", "　x\x1c  y", "日本語 text"]
    texts += ["<|endoftext|>", "<|endoftext|> a", "a<|endoftext|>b  <|endoftext|><|endoftext|> ", "<|endoftext|", "< |endoftext|>"]
    texts += [x * 250_000 for x in ("x", " ", "\n", "#", "<|endoftext|> ")]
    texts += ["".join(rng.choice("abcdefgh+/019") for _ in range(250_000)), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(210_000))]
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i >> 16 in (0, 1, 2, 3, 14) or i % 31 == 0)]
    texts += ["".join(f"a{c}1 {c}b  {c}\n" for c in points[i : i + 4000]) for i in range(0, len(points), 4000)]
    for t in texts:
        assert e(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:80]


def test_token_counts(docs, rows):
    import public_tokenizers

    scores, byte = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))

    def count(word):
        best = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            own = [(best[i][0] + scores[word[i:j]], -(best[i][1] + 1)) for i in range(max(0, j - 20), j) if word[i:j] in scores]
            if word[j - 1] not in scores:
                n = len(word[j - 1].encode())
                own.append((best[-1][0] + n * byte, -(best[-1][1] + n)))
            s, t = max(own)
            best.append((s, -t))
        return best[-1]

    got = canon((r["doc_id"], r["n_words"], r["n_tokens"], round(r["score"], 3)) for r in token_counts.token_counts(docs).collect())
    want = []
    for d, t, *_ in rows:
        w = plain.words(t)
        own = [count(token_counts.MARK + x) for x in w]
        want.append((d, len(w), sum(n for _, n in own), round(sum(s for s, _ in own) + 0.0, 3)))
    assert [g[:3] for g in got] == [x[:3] for x in canon(want)]
    assert np.allclose([g[3] for g in got], [x[3] for x in canon(want)], atol=0.01)


def test_trie_starts_afresh():
    scores = {"a": -1.0, "b": -1.0, "ab": -1.5}
    small, large = token_counts.Trie(scores, -5.0, nodes=4), token_counts.Trie(scores, -5.0)
    for w in ("ab", "abab", "ba", "bbb", "aab", "é", ""):
        assert small.count(w) == large.count(w)
    assert large.count("abab") == (2, -3.0) and large.count("é") == (2, -10.0)


def test_flac_notices_damage():
    media = bytearray(flac.encode([b"some bytes that go wrong " * 40])[0])
    for at in (-3, -200, 90):
        bad = bytearray(media)
        bad[at] ^= 16
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(bad)])


def test_flac_checksums_are_the_bitwise_ones():
    rng = random.Random(3)
    for n in (1, 7, 300, 9000):
        data = bytes(rng.randrange(256) for _ in range(n))
        c = 0
        for b in data:
            c ^= b << 8
            for _ in range(8):
                c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        assert flac.crc16(np.frombuffer(data, np.uint8)) == c


def test_media_columns(docs, none):
    own = docs.withColumn("payload", F.col("text").cast("binary"))
    back = flac.read_back(flac.store(own), joined="whole").withColumn("parts", F.aggregate("blocks", F.lit("").cast("binary"), lambda a, b: F.concat(a, b["pcm"])))
    assert back.where("NOT whole <=> parts").count() == 0
    assert back.count() == docs.count()
    assert back.where("text IS NOT NULL AND (whole <> cast(text AS binary) OR media IS NULL)").count() == 0
    assert back.where("text IS NULL AND (media IS NOT NULL OR blocks IS NOT NULL)").count() == 0
    assert back.groupBy("text").agg(F.count_distinct("media").alias("n")).where("n > 1").count() == 0
    assert flac.read_back(flac.store(none.withColumn("payload", F.lit(None).cast("binary")))).count() == 0


def test_long_words_need_no_nodes():
    import public_tokenizers

    scores, byte = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(8)
    trie, plain_trie = token_counts.Trie(scores, byte), token_counts.Trie(scores, byte, long=10**9)
    for n in (999, 1000, 1001, 5000):
        word = token_counts.MARK + "".join(rng.choice(["the", "ation", "x", "日", "é", "qz", "ing", "00"]) for _ in range(n // 2))
        assert trie.count(word) == plain_trie.count(word)
    trie.clear()
    tokens, score = trie.count("ab" * 300_000 + "日本" * 1000)
    assert tokens > 1000 and score < 0 and len(trie.best) == 1 and not trie.counts


def test_licenses(spark, docs, none):
    texts = [
        "Intro words here.\nReleased under the MIT License.\nmore",
        "apache LICENSE apache license",
        "Licensed under CC BY-NC 4.0.",
        "cc by the way nc under licensed",
        "This work is licensed under the GNU General Public License, version 3.",
        " by someone ".join(LICENCES[1].needed).upper() + " end",
        None,
        "",
        "mit-license",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan(df, word_idf(df, licence_words())).collect()}
    label = lambda i: ({p["label"] for p in got[i]["places"]}, {h["label"] for h in got[i]["hits"]})
    assert label(0) == ({"mit"}, {"mit"}) and got[0]["places"][0]["first_word"] == 6
    assert label(1)[0] == {"apache"} and [p["first_word"] for p in got[1]["places"]] == [0, 2]
    assert label(2) == (set(), {"cc-by-nc"}) and label(3) == (set(), set())
    assert label(4) == ({"gpl"}, {"gpl"}) and label(5) == (set(), {"mit"})
    assert label(6) == label(7) == (set(), set()) and label(8)[0] == {"mit"}
    assert got[5]["hits"][0]["matched"] == 1.0
    found = scan(docs, word_idf(docs, licence_words()))
    assert found.count() == docs.count()
    assert scan(none, word_idf(none, licence_words())).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    bad = ["vile", "awful", "rotten", "horrid"]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        toxic = int(i % 7 == 0)
        for _ in range(rng.randint(2, 9) * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad)
        docs.append((i, " ".join(w)))
        if i < 600:
            labels.append((i, toxic))
    docs = spark.createDataFrame([*docs, (900, None), (901, ""), (None, "vile rotten awful")], "doc_id long, text string")
    labels = spark.createDataFrame([*labels, (None, 1), (5, None), (5000, 1)], "doc_id long, toxic int")
    own = toxicity.sample(docs, labels)
    model = toxicity.fit(own, toxicity.severity(own))
    got = toxicity.predict(docs, model).collect()
    held = [r for r in got if r["doc_id"] is not None and 600 <= r["doc_id"] < 900]
    right = sum(r["toxic"] == (r["doc_id"] % 7 == 0) for r in held)
    assert right >= 0.95 * len(held), (right, len(held))
    assert all(np.diff(model.thresholds) >= 0) and len(got) == 903
    by = {r["doc_id"]: r for r in got}
    assert not by[900]["toxic"] and by[900]["expected_severity"] == by[901]["expected_severity"] == 0 and by[None]["toxic"]


def test_toxicity_without_labels(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    own = toxicity.sample(docs, labels)
    got = toxicity.predict(docs, toxicity.fit(own, toxicity.severity(own))).collect()
    assert len(got) == docs.count() and all(r["expected_severity"] == 0 and not r["toxic"] for r in got)
    assert toxicity.predict(none, toxicity.fit(own, toxicity.severity(own))).count() == 0
