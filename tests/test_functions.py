import math

import pytest
from pyspark.sql import functions as F

from brindle.functions import stats as S
from brindle.functions import text as X
from brindle.functions import urls as U

GOLDENS = [
    ("http://Shop.Anchor.test", "http://shop.anchor.test/"), ("hTTpS://anchor.test:443", "https://anchor.test/"), ("https://anchor.test:444/oars", "https://anchor.test:444/oars"), ("http://anchor.test:80/oars/", "http://anchor.test/oars/"), ("https://www.anchor.test/Oars#sizes", "https://www.anchor.test/Oars"),
    ("https://anchor.test/oars?size=9&colour=red&size=10", "https://anchor.test/oars?colour=red&size=10&size=9"), ("https://anchor.test/oars?gclid=1&utm_term=x", "https://anchor.test/oars"), ("https://anchor.test/oars?Utm_Id=4&page=2", "https://anchor.test/oars?page=2"), ("https://anchor.test/%6Fars%2d1/%C5%82%c3%b3d%c5%ba", "https://anchor.test/oars-1/%C5%82%C3%B3d%C5%BA"),
    ("https://łódź.test/wiosła", "https://xn--d-uga0v4h.test/wios%C5%82a"), ("https://me:secret@anchor.test/x/./y/../z/", "https://anchor.test/x/z/"), ("tel:+48123", None), ("/oars", None), ("", None), (None, None),
]


@pytest.mark.parametrize("raw,want", GOLDENS)
def test_normalize(raw, want):
    assert U.normalize(raw) == want


def test_normalize_in_spark(spark):
    df = spark.createDataFrame([(r,) for r, _ in GOLDENS], "u string").withColumn("n", U.normalize_url("u"))
    assert [r.n for r in df.collect()] == [w for _, w in GOLDENS]


@pytest.mark.parametrize("href,want", [("/a#b", "https://x.example/a"), ("", None), ("javascript:void(0)", None), ("//y.example/z", "https://y.example/z"), ("tel:1", None), ("b?c=1", "https://x.example/d/b?c=1")])
def test_resolve(href, want):
    assert U.resolve(href, "https://x.example/d/e") == want


TAILS = [("https://a.test/b).", "https://a.test/b"), ("https://a.test/b_(c)", "https://a.test/b_(c)"), ("https://a.test/b_(c)).", "https://a.test/b_(c)"), ("https://a.test/x”,", "https://a.test/x"), ("https://a.test/[1]]}", "https://a.test/[1]"), ("https://a.test/", "https://a.test/"), ("?!", ""), (None, None)]


def test_trim_tail(spark):
    df = spark.createDataFrame([(r,) for r, _ in TAILS], "u string").select(U.trim_url_tail(F.col("u")).alias("t"))
    assert [r.t for r in df.collect()] == [w for _, w in TAILS]


def test_crawl_start_and_stamp(spark):
    df = spark.createDataFrame([("sc-domain:anchor.test",), ("https://Anchor.test/shop/",)], "u string")
    assert [r.s for r in df.select(U.crawl_start(F.col("u")).alias("s")).collect()] == ["https://anchor.test/", "https://Anchor.test/shop/"]
    assert {r.s.version for r in df.select(U.stamped(F.col("u")).alias("s")).collect()} == {U.NORMALIZER_VERSION}


def test_slug_marks(spark):
    df = spark.createDataFrame([("Łódź ǎ ḱ — Ünïcode",), (None,), ("a" * 59 + " bc",)], "t string").select(X.slug(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == ["lodz-a-k-unicode", "", "a" * 59 + "-"]


def test_url_parts(spark):
    r = spark.sql("select 'https://www.a.example:81/wiki/how-it_works.html?x=1' as u, 'https://www.a.example:81/wiki/' as p").select(
        U.host(F.col("u")).alias("h"), U.citation_host(F.col("u")).alias("c"), U.section(F.col("u")).alias("s"), U.humanized(F.col("u")).alias("w"), U.in_scope(F.col("u"), F.col("p")).alias("i"), U.path_problems(F.col("u")).alias("pr")
    ).first()
    assert (r.h, r.c, r.s, r.w, r.i, r.pr) == ("www.a.example:81", "a.example:81", "wiki", "how it works", True, ["underscore"])


def test_text(spark):
    r = spark.sql("select 'Jak testować buty do biegania w zimie, a co z latem?' as t, '  Zażółć GĘŚLĄ jaźń -- x! ' as s, 'a\\r\\nb  c\\n\\n\\n\\nd ' as a").select(
        X.content_tokens("t").alias("tok"), X.slug(F.col("s")).alias("slug"), X.normalize_answer(F.col("a")).alias("norm"), X.word_count("t").alias("n"), X.shingles(X.words("t"), 3).alias("sh"), X.shingles(X.words(F.lit("a b")), 3).alias("none")
    ).first()
    assert r.tok == ["testować", "buty", "biegania", "zimie", "latem"]
    assert r.slug == "zazolc-gesla-jazn-x" and r.norm == "a\nb c\n\nd" and r.n == 11
    assert r.sh[0] == "jak testować buty" and len(r.sh) == 9 and r.none == []


def _mulberry(seed, n):
    out, state = [], seed & 0xFFFFFFFF
    for _ in range(n):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ state >> 15) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        out.append((t ^ t >> 14) / 4294967296)
    return out


def test_draws(spark):
    got = [r.u for r in spark.range(1, 501).select("id", S.draw(12345, F.col("id")).alias("u")).orderBy("id").collect()]
    assert got == _mulberry(12345, 500)


def test_wilson(spark):
    low, high = S.wilson("h", "n")
    rows = spark.createDataFrame([(0, 0), (0, 5), (5, 5), (3, 10)], "h int, n int").select("h", "n", low.alias("l"), high.alias("u"), S.rate("h", "n").alias("r")).collect()
    assert (rows[0].l, rows[0].u, rows[0].r) == (0.0, 1.0, 0.0)
    assert rows[1].l == 0.0 and 0 < rows[1].u < 1 and rows[2].u == 1.0 and 0 < rows[2].l < 1
    assert math.isclose(rows[3].l, 0.10779, abs_tol=1e-4) and math.isclose(rows[3].u, 0.60322, abs_tol=1e-4)


def test_detectable(spark):
    d = spark.sql("select 50 m, 3 n union all select 0, 3").select(S.detectable_difference("m", "n").alias("d")).collect()
    assert math.isclose(d[0].d, 0.1132, abs_tol=1e-4) and d[1].d == 1.0
