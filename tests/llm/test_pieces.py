"""Encoding with offsets against the library of the model file."""

import random

import plain
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from planegrid.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def strange(n, seed=1):
    rng = random.Random(seed)
    parts = ["the", "The", " ", "  ", "     ", "▁", "▁▁", "\n", "\t", "é", "é", "ﬃ", "①", "漢字", "𠀀", "　", "\xa0", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "\x7f", "�", "﻿", "ing", "ation", "123", "ß", "नमस्ते", "🙂", "‍", "aaaaaaa", "…"]
    for _ in range(n):
        yield "".join(rng.choice(parts) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(30)))


def test_same_ids_spans_and_texts(spark, library):
    texts = [*strange(4000), "", " ", "▁", " " * 1000, "a" * 5000, "word " * 3000, "ab▁cd " * 700]
    df = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(4)
    rows = pieces.decode(pieces.encode(df)).collect()
    assert {(r["doc_id"], r["decoded"]) for r in rows} == {(r["doc_id"], r["decoded"]) for r in pieces.encode(df, decoded=True).collect()}
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = "" if r["doc_id"] is None else texts[r["doc_id"]]
        ids = library.encode(text, add_eos=True)
        assert r["ids"] == ids, text
        assert r["decoded"] == library.decode(ids)
        own = library.encode(text, return_type="proto").pieces
        begins, ends = [p.begin for p in own], [p.end for p in own]
        assert r["ends"] == [*ends, len(text.encode())], text
        assert [r["begin"], *r["ends"]][: len(begins)] == begins, text


def test_any_ids_decode(spark, library):
    """Ids in no order: broken characters in byte pieces, control and unknown ids, blanks at the start."""
    rng = random.Random(3)
    some = [0, 1, 2, 259, 260, 29871, *range(3, 259)]
    rows = [(i, None if i % 50 == 3 else [rng.choice(some) if rng.random() < 0.8 else rng.randrange(32000) for _ in range(rng.randrange(12))]) for i in range(3000)]
    got = {r["i"]: r["decoded"] for r in pieces.decode(spark.createDataFrame(rows, "i int, ids array<int>")).collect()}
    for i, ids in rows:
        assert got[i] == library.decode(ids or []), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_normalisation_by_a_character_map(rule, squeeze, prefix):
    """Compiled maps that the library brings along; its places are characters of the source."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, escape_whitespaces=True, remove_extra_whitespaces=squeeze, add_dummy_prefix=prefix)
    spec = sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    own = pieces.Normalizer(pieces.character_map(spec.precompiled_charsmap), prefix, squeeze)
    assert rule == "identity" or len(own.rules) > 1000
    for text in [*strange(1500, 7), "", "  ", "  a  b  ", "　x　", "ｱﾞ ｱ", "½ ⅷ  ", "がぎ"]:
        want, at = library.normalize(text, with_offsets=True)
        got, places = own(text)
        assert got == want, repr(text)
        chars = [0]
        for c in text:
            chars.append(chars[-1] + len(c.encode()))
        assert places.tolist() == [chars[i] for i in at], repr(text)


def test_query_on_edge_cases(spark, docs, rows, none, library, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, text, *_ in rows:
        ids = library.encode(text or "", add_eos=True)
        want.append((d, len(ids), plain.sha(" ".join(map(str, ids))), plain.sha(library.decode(ids)), len((text or "").encode())))
    got = [tuple(r) for r in pieces.op11_offset_pieces(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pieces.decode(pieces.encode(none)).count() == 0


def test_memory_of_segments_starts_anew(library):
    table = pieces.Segments(pieces.Model(PATH))
    first = [table[s] for s in ("▁one", "▁two", "▁one")]
    assert first == [0, 1, 0]
    table.forget()
    assert table["▁two"] == 0 and library.id_to_piece(table.ids[0]) == "▁two"


def test_both_ways_of_merging():
    own = pieces.Model(PATH)
    rng = random.Random(9)
    for _ in range(2000):
        s = "".join(rng.choice(["a", "e", "t", "th", "in", "▁", "é", "漢"]) for _ in range(rng.randrange(1, 30)))
        assert own._few(s) == own._many(s), s
