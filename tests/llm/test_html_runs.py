import random
import resource
import time

import pytest

from lakewarden.llm import html_text

SHELL = "<body><div>Shop</div><div>{}</div><div>Call us</div></body>"


def texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}


def test_a_host_of_two_pages_wherever_runs_are_cut(spark):
    # Hosts with one page each stand before the two pages: they are at ranks 15 and 16.
    pages = [(i, f"http://a{i:02}.com/x", SHELL.format(f"alone {i}")) for i in range(15)]
    pages += [(50, "http://b.com/1", SHELL.format("first")), (51, "http://b.com/2", SHELL.format("second"))]
    got = texts(spark, pages)
    assert (got[50], got[51]) == ("first", "second")
    assert all(got[i] == f"Shop alone {i} Call us" for i in range(15))


@pytest.mark.parametrize("copies", [16, 40])
def test_more_copies_than_a_run_holds(spark, copies):
    pages = [(i, f"http://c.com/a/{i:03}", SHELL.format("same")) for i in range(copies)] + [(900, "http://c.com/b", SHELL.format("last"))]
    got = texts(spark, pages)
    assert got == {i: "same" for i in range(copies)} | {900: "last"}


def test_every_page_of_many_hosts(spark):
    pages = [(100 * h + i, f"http://h{h}.com/{i:02}", SHELL.format(f"text {h} {i}")) for h in range(12) for i in range(2 + h % 5)]
    assert texts(spark, pages) == {p: f"text {p // 100} {p % 100}" for p, _, _ in pages}


def test_lines_that_polynomials_confuse(spark):
    # The Thue-Morse word and its complement: equal by every polynomial hash modulo 2^64.
    a = "".join("AB"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate(str.maketrans("AB", "BA"))
    pages = [(1, "http://h/1", f"<p>one</p><p>{a}</p>"), (2, "http://h/2", f"<p>two</p><p>{b}</p>")]
    assert texts(spark, pages) == {1: f"one {a}", 2: f"two {b}"}


@pytest.mark.parametrize(
    "page",
    ["<" + "a" * 1_000_000, "<a " * 350_000, "<a b=\">" * 160_000, "<a b='>\"" * 130_000, '<a b=">"' * 130_000, "<!x" * 350_000, "</a" * 350_000, "<div>" * 100_000 + "</span>" * 70_000, "<form><main>" * 90_000, "<p a" + " " * 1_000_000, "<p class=" + "x " * 500_000 + ">"],
    ids=lambda p: p[:12],
)
def test_a_megabyte_of_unfinished_markup(page):
    began = time.process_time()
    html_text.lines(page + "<p>end</p>")
    assert time.process_time() - began < 20


def test_quotes():
    def text(page):
        return " ".join(t for t, _ in html_text.lines(page))

    assert text("<p class=it's>text</p>") == "text"
    assert text('<p title="abc>text</p>') == "text"
    assert text('<p title="a > b" class=\'c > d\'>text</p>') == "text"
    assert text("<p it's>text</p><p>don't</p>") == "text don't"
    assert text('<p title = "x>y">text</p>') == "text"
    assert text("<p>1 < 2 and 2 > 1</p>") == "1 < 2 and 2 > 1"
    assert text("<p>a <b") == "a <b"
    assert text("<p>a</p><!-- b <p>c</p>") == "a"
    assert text('<p a=">"') == '<p a=">"' or text('<p a=">"') == '"'


def longest(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_alignments_are_longest():
    rng = random.Random(8)
    for _ in range(400):
        a, b = ([rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randrange(25))] for _ in "ab")
        at = html_text.aligned(a, b)
        assert at == sorted(set(at)) and len(at) == longest(a, b)
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in at)


def test_an_alignment_of_many_lines_in_little_memory():
    rng = random.Random(2)
    a = list(range(20_000))
    b = [x if rng.random() < 0.7 else -rng.randrange(1, 20_000) for x in a]
    rng.shuffle(b)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    at = html_text.aligned([-1, *a, -2], [-3, *b, -4])
    assert len(at) > 100
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # kB; a table of lengths would take 1.6 GB
