import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bpe, packing

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = ["", "a", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", " lead", "trail ", "a \n b", "  ", " \x1c a", "a\x1c b \x1fc", "it's 'S we'll", "ñandú ²Ⅷ 日本語😀 é", "a" * 4000, " " * 3000 + "x", "\n\n\n x", "x" * 50 + " y" * 2000, "�\x00b"]


def ids(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.vocabulary_path())


@pytest.mark.parametrize("text", TEXTS)
def test_encodes_as_the_library(codec, text):
    assert codec.encode(text) == ids(text)
    assert codec.decode(ids(text)) == LIBRARY.decode(np.frombuffer(ids(text), "<u4").tolist(), skip_special_tokens=False)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t'sSre.,1aé  <|endoftext>", max_size=60)))
def test_encodes_any_text_as_the_library(codec, text):
    text = text.encode("utf-8", "replace").decode()
    assert codec.encode(text) == ids(text)
    assert codec.decode(codec.encode(text)) == text


def test_every_token_is_its_own_encoding(codec):
    raw = {i: s for s, i in codec.vocab.items()}
    for i in range(0, 50_256, 37):
        piece = raw[i].encode("latin-1")
        try:
            text = piece.decode()
        except UnicodeDecodeError:
            continue
        assert codec.encode(text) == ids(text)


def test_round_trip_in_spark(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(99, None, 1, "x"), (None, "a b", 1, "x")], "doc_id long, text string, n_tokens int, ids string").repartition(3)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs)).collect()}
    assert all(got[i].text == t and bytes(got[i].ids) == ids(t) and got[i].n_tokens == len(ids(t)) // 4 for i, t in enumerate(TEXTS))
    assert got[99].text == "" and got[99].n_tokens == 0 and got[None].text == "a b"
    assert bpe.encode(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_decreasing_equals_a_plain_search(sizes):
    rows, rooms = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in range(len(rooms)) if rooms[r] >= sizes[i]]
        if fits:
            least = min(rooms[r] for r in fits)
            assert least >= sizes[i]
            rooms[next(r for r in fits if rooms[r] == least)] -= sizes[i]
        else:
            rooms.append(40 - sizes[i])
            rows.append([])
    got = packing.best_fit_decreasing(sizes, 40)
    assert sorted(i for r in got for i in r) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= 40 for r in got)
    assert sorted(40 - sum(sizes[i] for i in r) for r in got) == sorted(rooms)


def test_packing_loses_nothing(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (51, "word " * 9000), (51, "word " * 9000), (None, "no id")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").repartition(2)
    packed = packing.pack(docs, row=256)
    for r in packed.collect():
        cu, n = r.cu_seqlens, r.n_tokens
        assert cu[0] == 0 and cu[-1] == n <= 256 and len(cu) == len(r.doc_ids) + 1 == len(r.doc_offsets) + 1
        positions, tokens = np.frombuffer(r.positions, "<u2"), np.frombuffer(r.ids, "<u2")
        assert len(positions) == len(tokens) == 256 and (tokens[n:] == 50256).all()
        assert positions[:n].tolist() == [k for a, b in zip(cu, cu[1:]) for k in range(b - a)]
    parts = {}
    for r in packing.unpack(packed).collect():
        parts.setdefault(r.doc_id, {}).setdefault(r.doc_offset, []).append(np.frombuffer(r.ids, "<u2"))
    for i, t in rows:
        whole = np.concatenate([parts[i][at][0] for at in sorted(parts[i])])
        assert whole[-1] == 50256
        assert bpe.codec(bpe.vocabulary_path()).decode(whole[:-1].astype("<u4").tobytes()) == (t or "")
    assert packed.select("pack_id").distinct().count() == packed.count()
    assert packing.pack(docs.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_packing_refuses_what_rows_cannot_hold(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for wrong in ({"end_id": 65_536}, {"end_id": -1}, {"row": 0}, {"row": 65_537}):
        with pytest.raises(ValueError):
            packing.pack(docs, **wrong)
    wide = tmp_path / "wide.tiktoken"
    wide.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b + 65_300}\n" for b in range(256)))
    with pytest.raises(ValueError):
        packing.tokenizer(str(wide))


def test_round_trip_is_decode_of_encode(spark):
    docs = spark.createDataFrame([(1, "Some words, and  more words.\n"), (2, None), (3, ""), (3, ""), (4, "né   " * 700)], "doc_id long, text string")
    one, two = bpe.round_trip(docs), bpe.decode(bpe.encode(docs))
    assert one.columns == two.columns
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert {r.doc_id: r.text for r in one.collect()}[4] == "né   " * 700
