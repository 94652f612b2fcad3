import hashlib
import random
import zlib

import duckdb
import pytest

from lakewarden.llm import html_text, matroska, mixing


def test_media_round_trip(spark, tmp_path):
    texts = [None, "", "a" * 192, "é漢" * 500, "x" * 200_000, "same", "same"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "nameless", 1)], "doc_id long, text string, media int")
    matroska.write_media(df, str(tmp_path / "m"))
    media = spark.read.parquet(str(tmp_path / "m"))
    got = {r["doc_id"]: r for r in matroska.media_features(media).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert {k: v for k, v in got[5].asDict().items() if k != "doc_id"} == {k: v for k, v in got[6].asDict().items() if k != "doc_id"}
    packets = matroska.packet_table(media).where("doc_id = 4").orderBy("packet").collect()
    assert [p["ms"] for p in packets[:3]] == [0.0, 24.0, 48.0] and sum(p["size"] for p in packets) == -(-200_000 // 192) * 192
    assert matroska.media_features(media.limit(0)).count() == 0


def _block(flags, body):
    return matroska._element(matroska.SIMPLE_BLOCK, b"\x81\x00\x05" + bytes([flags]) + body)


def test_every_lacing_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 20, b"c" * 500]
    xiph = b"\x02" + b"\xff\x2d" + b"\x14" + b"".join(frames)
    ebml = b"\x02" + matroska._size(300) + ((20 - 300 + (1 << 13) - 1) | 1 << 14).to_bytes(2, "big") + b"".join(frames)
    fixed = b"\x01" + b"d" * 10 + b"e" * 10
    group = matroska._element(matroska.BLOCK_GROUP, matroska._element(matroska.BLOCK, b"\x81\x00\x00\x00zz"))
    cluster = matroska._uint(matroska.TIMESTAMP, 1000) + _block(0x02, xiph) + _block(0x06, ebml) + _block(0x84, fixed) + group
    data = matroska._element(matroska.EBML, b"") + matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + matroska._element(matroska.CLUSTER, cluster)
    got = matroska.parse(data)
    assert [data[p[2] : p[2] + p[3]] for p in got["packets"]] == [*frames, *frames, b"d" * 10, b"e" * 10, b"zz"]
    assert got["packets"][0][1] == 1005 and got["clusters"] == 1


UNKNOWN_SIZE = b"\x01" + b"\xff" * 7


def test_unknown_sizes_end_at_the_next_sibling():
    part = lambda k: matroska._id(matroska.CLUSTER) + UNKNOWN_SIZE + matroska._uint(matroska.TIMESTAMP, k) + _block(0x80, b"zz")
    head = matroska._element(matroska.EBML, b"") + matroska._id(matroska.SEGMENT) + UNKNOWN_SIZE
    cues = matroska._element(matroska.CUES, matroska._element(matroska.CUE_POINT, matroska._uint(matroska.CUE_TIME, 7)))
    data = head + b"".join(map(part, range(5000))) + cues + matroska._element(0x1254C367, b"")
    got = matroska.parse(data)
    assert got["clusters"] == 5000 == len(got["packets"]) and not got["damaged"]
    assert [p[1] for p in got["packets"][:3]] == [5, 6, 7] and {p[3] for p in got["packets"]} == {2}
    assert {(d, k) for d, k, _, _ in matroska.elements(data)} >= {(1, matroska.CLUSTER), (2, matroska.SIMPLE_BLOCK), (1, matroska.CUES), (2, matroska.CUE_POINT)}


def test_damaged_files_keep_what_was_read(spark):
    data, r = matroska.mux(b"q" * 192 * 500), random.Random(3)
    whole = matroska.parse(data)
    assert not whole["damaged"] and not matroska.parse(b"")["packets"]
    assert matroska.parse(b"\x00\x01\x02")["damaged"] and matroska.parse(data[:-1])["clusters"] == 3
    cut = matroska.parse(data[: len(data) // 2])
    assert 0 < len(cut["packets"]) < len(whole["packets"]) and cut["packets"][:100] == whole["packets"][:100]
    for _ in range(300):
        bad = bytearray(data)
        for _ in range(r.randint(1, 6)):
            bad[r.randrange(len(bad) if r.random() < 0.3 else 400)] = r.randrange(256)
        assert all(p[3] >= 0 and p[2] + p[3] <= len(bad) for p in matroska.parse(bytes(bad))["packets"])
    rows = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"\x00junk")), (3, None), (4, bytearray(data[:5000]))], "doc_id long, media binary")
    n = {x["doc_id"]: x["count"] for x in matroska.packet_table(rows).groupBy("doc_id").count().collect()}
    assert n[1] == 500 and n.keys() == {1, 4} and 0 < n[4] < 500


def test_registered_media_equal_payloads(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = matroska.op7_matroska(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_cues_point_at_clusters():
    data = matroska.mux(b"q" * 192 * 500)
    got = matroska.parse(data)
    assert len(got["cues"]) == got["clusters"] == 3
    assert all(data[c[2] : c[2] + 4] == matroska._id(matroska.CLUSTER) for c in got["cues"])


def _mixed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string")


def test_mix_equals_sql(spark, tmp_path):
    r = random.Random(2)
    data = [(i, None if i == 9 else " ".join(["w"] * r.randint(0, 30)), r.choice(["a", "b", "c", "É", None]), "x") for i in range(300)] + [(300 + i, "w " * 10, "d", "x") for i in range(900)]
    df = _mixed(spark, data)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, mixing.op6_mixing(spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(mixing.OP6_SQL).fetchall())
    by = {d: s for d, _, s, _ in data}
    taken, target = {}, {}
    for d, size, _, t, k in got:
        assert 0 <= k <= 3 * size
        taken[by[d]] = taken.get(by[d], 0) + k
        target[by[d]] = t
    assert all(abs(taken[s] - target[s]) <= mixing.QUANTUM for s in target)
    assert sum(taken.values()) == sum(g[1] for g in got)  # the budget is met to the word
    assert abs(sum(target.values()) - sum(g[1] for g in got)) < 1e-6


def test_mix_of_odd_tables(spark):
    assert mixing.queued(_mixed(spark, []).limit(0)).count() == 0
    empty = _mixed(spark, [(1, None, None, ""), (2, " ", "a", "")])
    assert [r["size"] for r in mixing.queued(empty).collect()] == [0, 0] and mixing.mixture(empty).count() == 0


def test_mixture_repeats_whole_rows(spark):
    df = _mixed(spark, [(i, "w " * 10, "a", "x") for i in range(10)] + [(100 + i, "w " * 10, "b", "x") for i in range(40)] + [(7, "w " * 10, "a", "x")])
    got = mixing.mixture(df)
    assert got.columns == df.columns
    n = {s: got.where(f"source = '{s}'").count() for s in "ab"}
    assert abs(n["a"] - 17) <= 1 and abs(n["b"] - 34) <= 1
    assert got.where("doc_id = 7").count() >= 2


def test_packets_are_served_by_virtual_finish_time(spark):
    r = random.Random(5)
    data = [(i, "w " * r.choice([0, 1, 7, 300, 900, 2000]), r.choice("abcd"), "x") for i in range(60)] + [(60, "w " * 50_000, "e", "x")]
    rows = mixing.queued(_mixed(spark, data)).collect()
    line = []
    for x in rows:
        for copy in range(3):
            for begin in range(0, x["size"], 256):
                n = min(256, x["size"] - begin)
                line.append(((x["start"] + x["source_size"] * copy + begin + n) / x["target"], x["at"], copy, n))
    left, want = sum(x["size"] for x in rows), {}
    for finish, at, copy, n in sorted(line):
        n = min(n, left)
        left -= n
        if n:
            want[at, copy] = want.get((at, copy), 0) + n
    got = {(x["at"], x["copy"]): x["taken"] for x in mixing.served(mixing.queued(_mixed(spark, data))).collect()}
    assert got == want


def test_mixture_keeps_columns_of_any_name(spark):
    names = ["n", "row", "of", "at", "finish", "__finish", "taken", "size", "__id", "copy"]
    df = _mixed(spark, [(i, "w " * 10, "ab"[i % 2], "x") for i in range(20)] + [(None, "w w", None, None)] * 3)
    for k, name in enumerate(names):
        df = df.withColumn(name, df["doc_id"] * 10 + k)
    got = mixing.mixture(df)
    assert got.columns == df.columns
    for r in got.collect():
        assert all(r[name] == (None if r["doc_id"] is None else r["doc_id"] * 10 + k) for k, name in enumerate(names))


PAGE = "<html><head><title>T</title><script>x</p></script></head><body><nav><ul><li>Home<li>About</ul></nav>{}<footer>&copy; us</footer></body>"


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain  &lt;text&gt;", "plain <text>"),
        (PAGE.format("<article><h1>A &amp; B</h1><p>one\n two<p>three<br>four</article><aside>ad</aside>"), "A & B one two three four"),
        (PAGE.format("<div class='cookie-notice'>ok?</div><main><p>body</p><form>mail <input></form><div id=comments>bad</div></main>"), "body"),
        (PAGE.format("<article>open <b>tags <!-- gone --> stay"), "open tags stay"),
        ("<article><p title='a>b'>x</p></article>", "x"),
        ("<style>p{}</style><p>unmarked", "unmarked"),
        ("<p>a<script>never closed", "a"),
        ("<article><p class='advert'>buy</p><p>one<ul><li class=comment>bad<li>two</ul><p hidden>no<p>three</article>", "one two three"),
        ("<article><p>fo<span class='ad'>x</span>o <b style='display: none'>no</b><i data-hidden='a' title='is hidden'>bar</i></p></article>", "foo bar"),
        ("<form><div>top</div><article><p>a</p><form>mail</form></article></form>", "a"),
        ("<form action=x><p>all of it</p></form>", "all of it"),
        ("<p>text</p><form>name</form>", "text"),
        ("<article><div class='related-work'>cited</div><div class='related-posts'>more</div><div class='cookieNotice'>ok</div></article>", "cited"),
        ("<article>caf&eacute; &#8217;&#x41;&amp;lt;</article>", "café ’A&lt;"),
    ],
)
def test_page_text(spark, page, want):
    df = spark.createDataFrame([(1, "http://h/a", page, "x")], "page_id long, url string, html string, text string")
    r = html_text.main_text(df).first()
    assert (r["text"], r["n_chars"]) == (want, len(want))


def test_shared_lines_of_a_host_go(spark):
    shell = "<body><div>Shop</div><div>{}</div><div>Call us</div></body>"
    pages = [(i, f"http://h.com/p/{i}?q=1", shell.format(f"text {i}")) for i in range(40)] + [(99, "http://other.com/x", shell.format("alone")), (None, None, None)]
    pages += [(200, "http://copy.com/1", shell.format("same")), (201, "http://copy.com/2", shell.format("same"))]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"text {i}" for i in range(40) if i not in ())
    assert got[99] == "Shop alone Call us" and got[None] == "" and got[200] == "Shop same Call us"


def test_longest_common_subsequence():
    r = random.Random(0)
    for _ in range(300):
        a, b = [[r.randint(0, 4) for _ in range(r.randint(0, 9))] for _ in range(2)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        at = html_text.aligned(a, b)
        assert len(at) == best[-1][-1] and at == sorted(set(at))
        it = iter(b)
        assert all(any(a[i] == x for x in it) for i in at)


def test_long_pages_equal_rows_and_clashing_names(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 60_000 + "</article>"
    rows = [(1, "http://h/a", long, 5, 6), (1, "http://h/a", long, 5, 6), (2, "http://h/b", "<div>x", 5, 6)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, mark int, gone int")).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, 60_000 * 12 - 1)] * 2 + [(2, 1)]


def test_differencing_equals_brute_force(spark):
    """Pages of one host by path; each loses the lines of a longest common subsequence with the nearest page on either side that has other lines."""
    r = random.Random(8)
    pages = []
    for host in range(6):
        for i in range(r.randint(1, 40)):
            body = r.choice([["a", "b"], ["a", "x%d" % r.randint(0, 3), "c"], ["b", "c", "y%d" % i]])
            pages.append((len(pages), f"http://h{host}.com/{i:03}", "".join(f"<div>{x}</div>" for x in body), body, host))
    want = {}
    for i, (page, _, _, body, host) in enumerate(pages):
        gone = set()
        for way in (-1, 1):
            j = i + way
            while 0 <= j < len(pages) and pages[j][4] == host and pages[j][3] == body:
                j += way
            if 0 <= j < len(pages) and pages[j][4] == host:
                gone |= {body[k] for k in html_text.aligned([hash(x) for x in body], [hash(x) for x in pages[j][3]])}
        want[page] = " ".join(x for x in body if x not in gone)
    r.shuffle(pages)
    got = html_text.main_text(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")).collect()
    assert {x["page_id"]: x["text"] for x in got} == want


def test_registered_pages_equal_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(map(tuple, html_text.op4_html_text(spark, sf).collect())) == sorted(con.sql(html_text.OP4_SQL).fetchall())


def test_empty_pages(spark):
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
