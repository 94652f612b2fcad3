import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakewarden.llm import packing, tokens

TEXTS = [None, "", "a", "Same text here.", "Same text here.", " lead  two\n\nlines ", "x\ny z\tw", "naïve 漢字 <|endoftext|> end", "word " * 5000, "don't stop's 12.5 %%% !!"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab1.'!é漢 \x1c", max_size=40), max_size=6))
def test_encoder_equals_library(texts):
    e = tokens.encoder(tokens.vocabulary_path())
    assert e.encode(texts) == [e.whole(t) for t in texts]


def test_encoder_forgets(plain):
    e = tokens.Encoder(tokens.vocabulary_path(), remember=3)
    for k in range(5):
        assert e.encode([f"alpha beta {k} gamma\ndelta {k}x"]) == [plain(f"alpha beta {k} gamma\ndelta {k}x").tobytes()]


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_file_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n).astype("<u4")
    d, lengths, back = tokens.from_file(tokens.to_file([4, -9], [n, 0], ids.tobytes(), bits, block=64))
    assert list(d) == [4, -9] and list(lengths) == [n, 0] and (back == ids).all()


def test_files_in_order_and_read_back(spark, plain, tmp_path, monkeypatch):
    df = spark.createDataFrame([(100 - i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, start string").repartition(3)
    tokens.write_token_files(df, str(tmp_path / "t"), bits=True)
    got = sorted(tokens.read_token_files(spark, str(tmp_path / "t"), with_ids=True).collect(), key=lambda r: r["doc_id"])
    at = 0
    for r, (d, t) in zip(got, sorted((100 - i, t) for i, t in enumerate(TEXTS))):
        ids = np.append(plain(t), np.uint32(2)).astype("<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (d, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        at += len(ids)


def test_null_ids_come_first_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(3, "b"), (None, "a"), (3, "b")], "doc_id long, text string")
    tokens.write_token_files(df, str(tmp_path / "t"))
    assert sorted((r["start"], r["doc_id"]) for r in tokens.read_token_files(spark, str(tmp_path / "t")).collect()) == [(0, None), (2, 3), (4, 3)]
    tokens.write_token_files(df.limit(0), str(tmp_path / "e"))
    assert tokens.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_pack(spark, plain):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "nameless", 1), (3, "again", 1)], "doc_id long, text string, length int")
    got = packing.pack(df.coalesce(1), with_ids=True).collect()
    by = {}
    for r in got:
        assert len(bytes(r["ids"])) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    for i, t in enumerate(TEXTS):
        if i != 3:
            whole = b"".join(bytes(r["ids"]) for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]))
            assert whole == np.append(plain(t), np.uint32(1)).astype("<u4").tobytes()
    assert packing.pack(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 40))
def test_fill_is_the_closest_sum(counts, room):
    reach = {0}
    for length, n in counts.items():
        reach = {s + length * k for s in reach for k in range(n + 1)}
    chosen, slack = packing.fill(counts, room)
    assert all(k <= counts[x] for x, k in chosen.items())
    assert sum(x * k for x, k in chosen.items()) == room - slack == max(s for s in reach if s <= room)


def placed_ids(pieces, n):
    by = {}
    for p in pieces:
        by.setdefault(p[5], []).append((p[6], p[2]))
    for seq in by.values():
        end = 0
        for offset, length in sorted(seq):
            assert offset == end and length > 0
            end += length
        assert end <= n
    return by


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=40), st.integers(1, 3))
def test_packer_leaves_less_than_a_window_and_no_slack(lengths, pools):
    packer, out = packing.Packer(16), []
    for i, n in enumerate(lengths):
        out += packer.add((i, 0, np.arange(n, dtype="<u4").tobytes(), n))
        if i % (len(lengths) // pools + 1) == 0:
            out += packer.pack()
            assert packer.ids < 16
    out += packer.pack()
    full = placed_ids(out, 16)
    assert all(sum(x for _, x in v) == 16 for v in full.values())
    out += packer.rest()
    assert len(placed_ids(out, 16)) == -(-sum(lengths) // 16)
    for i, n in enumerate(lengths):
        mine = sorted((p[1], p[7]) for p in out if p[0] == i)
        assert b"".join(x for _, x in mine) == np.arange(n, dtype="<u4").tobytes()
        assert [a for a, _ in mine] == np.cumsum([0] + [len(x) // 4 for _, x in mine])[:-1].tolist()


@pytest.mark.parametrize("parts", [1, 8, 100])
def test_little_padding_however_rows_are_split(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack(docs.repartition(parts)).groupBy("sequence_id").agg({"length": "sum"}).collect()
    used = [r[1] for r in got]
    assert max(used) <= 2048 and sum(used) >= 0.995 * 2048 * len(used)


def test_little_padding_of_equal_lengths(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('a ', 1499) as text")
    got = packing.pack(docs).groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert sum(r[1] for r in got) >= 0.995 * 2048 * len(got)


def test_registered_packing_over_the_whole_table(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    by = {}
    for r in packing.op9_packing(spark, sf).collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert by.keys() == {d["doc_id"] for d in docs}
    for d in docs:
        ids, at = np.append(plain(d["text"]), np.uint32(1)).astype("<u4"), 0
        for r in sorted(by[d["doc_id"]], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_registered_token_files_over_the_whole_table(spark, sf, plain):
    docs = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()), key=lambda r: r[0])
    got = sorted(map(tuple, tokens.op8_token_planes(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    want, at = [], 0
    for d, t in docs:
        ids = np.append(plain(t), np.uint32(2)).astype("<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
