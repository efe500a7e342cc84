"""Operators against brute force, libraries and round trips, on small tables with every awkward row."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_text, language_id, media, near_dedup, packing, pieces, retrieval, token_counts, url_filters
from tidemark.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
WORDS = "the of house water and garden tree walks slowly under blue sky while seven birds sing".split()


def sentence(seed: int, n: int = 40) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = sentence(1, 120)
EDITED = BASE.replace("garden", "Garden!", 1) if "garden" in BASE else BASE + " end"
ROWS = [
    (None, "no id " + sentence(2)), (1, None), (2, ""), (3, " \t\n "), (4, BASE), (4, BASE), (5, BASE), (6, EDITED), (7, "Wörter über Straßen"), (8, "12 !!! …"),
    (9, sentence(3) + " " + BASE[40:140] + " " + sentence(4)), (10, "日本語 <|endoftext|> ☃  x"), (11, "a b"), (12, "A  B"), (13, "z" * 60_000 + " " + BASE * 20), (14, BASE[100:160]),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    extra = ("row", "key", "id", "component", "kept", "n_tokens", "starts", "lang_pred", "piece", "part", "answers")
    return df.withColumns({c: F.lit("clash") for c in extra}).withColumn("lang", F.when(F.col("doc_id") != 8, "en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = by_id(token_counts.token_counts(docs), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x in ROWS]
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(none).count() == 0


def test_token_counts_of_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, dictionaries = Tokenizer.from_file(path), token_counts._dictionaries(path)
    rng = random.Random(5)
    parts = ["a", "The", "'s", " ", "  ", "\n", "12", "é", "!!", "<|endoftext|>", "<|", "日本", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "\u200b", "ß", "_", "\x00", "²", "\u180e"]
    for _ in range(2000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert token_counts.count_text(x, *dictionaries)[1] == len(t.encode(x, add_special_tokens=False).ids), repr(x)


def test_packing_ids_of_odd_texts():
    ids = packing._Ids(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(6)
    parts = ["a", "The", "'LL", " ", "\n", "12", "é", "É", "!!", "<|endoftext|>", "<|startoftext|>", "日本", "\t", "\u00a0", "\x1c", "\x85", "\ufeff", "İ", "Σ", "_", "\x00", "'", "²", "\u0300"]
    for _ in range(2000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        got = ids.ids(x) if packing._ODD.search(x) else b"".join(map(ids.__getitem__, x.split()))
        assert got == ids.ids(x), repr(x)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_plan_equals_placing_one_by_one(seed):
    import bisect

    rng = random.Random(seed)
    lengths = [rng.choice((rng.randint(1, 64), 21, 40)) for _ in range(800)]
    steps, bins = packing.best_fit_plan({n: lengths.count(n) for n in set(lengths)}, 64)
    room: list[int] = []
    count = 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(room, n)
        count += at == len(room)
        left = (room.pop(at) if at < len(room) else 64) - n
        if left:
            bisect.insort(room, left)
    held: dict[int, list] = {}
    placed = 0
    for length, _, n, each, first, offset in steps:
        for j in range(n):
            held.setdefault(first + j // each, []).append((offset + j % each * length, length))
            placed += 1
    assert placed == len(lengths) and len(held) == bins == count
    for parts in held.values():
        parts.sort()
        assert all(a == sum(n for _, n in parts[:i]) for i, (a, _) in enumerate(parts)) and sum(n for _, n in parts) <= 64
    assert bins <= -(-sum(lengths) // 64) * 11 / 9 + 1


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.best_fit_packing(docs).collect()
    want = []
    for i, x in ROWS:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert all(a == sum(n for _, n in parts[:i]) for i, (a, _) in enumerate(parts)) and sum(n for _, n in parts) <= 2048
    assert packing.best_fit_packing(none).count() == 0


def test_media_round_trip(spark, docs, none):
    stored = media.to_media(docs).persist()
    got = {r["doc_id"]: r for r in media.media_features(stored).collect()}
    for i, x in ROWS:
        raw = (x or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        clips = r["clips"]
        assert clips[0]["first_frame"] == 0 and sum(c["frames"] for c in clips) * 576 == len(payload) and r["feature"].startswith(f"{len(payload) // 576} frames")
    assert got[4]["media_sha256"] == got[5]["media_sha256"]
    assert media.media_features(media.to_media(none)).count() == 0
    assert media.clip_rows(media.media_features(stored)).count() >= len(ROWS)
    absent = spark.createDataFrame([(1, 2, None)], "doc_id long, n_bytes long, media binary")
    assert media.media_features(absent).first()["media_sha256"] is None


def test_frames_decode_in_another_decoder(spark):
    samples = np.random.default_rng(1).integers(0, 256, (2, 576), dtype=np.uint8)
    samples[1] = np.tile([0, 255], 288)
    jvm = spark._jvm
    for image, want in zip(media.encode_frames(samples), samples):
        raster = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(image))).getRaster()
        seen = [raster.getSample(8 * (k % 24) + 3, 8 * (k // 24) + 5, 0) for k in range(576)]
        assert seen == want.tolist()
    assert (media.decode_frames(media.encode_frames(samples)) == samples).all()


def test_shots_end_where_histograms_change():
    rng = np.random.default_rng(3)
    dark, light = rng.integers(0, 100, (20, 576)), rng.integers(150, 256, (20, 576))
    assert media.shot_bounds(np.vstack([dark, light]).astype(np.uint8)) == [0, 20, 40]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=x>Home</a></header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><main><article id=a%d><h1>Head &amp; line %d</h1><p>First <b>bold</b>word\n of %d<p>Second&nbsp;part<br>Third<!-- gone --><script>x("</p>")</script></p>
<aside>Side</aside><form><p>Fill in</p></form><div class="ad">Buy</div><section class="comments"><p>Nice!</p></section></article></main><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://host.example/{i}", PAGE % (i, i, i)) for i in range(5)]
    rows += [(90, None, None), (91, "x", ""), (92, "http://other.example/", "<p>Only <i>this</i><div class=sidebar>no</div>"), (93, "http://host.example/z", "<article><p>cut off &am"), (0, "http://host.example/0", PAGE % (0, 0, 0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "template", "region", "text", "token")})
    got = html_text.main_text(pages)
    assert got.count() == len(rows)
    text = {r["page_id"]: r["text"] for r in got.collect()}
    for i in range(5):
        assert text[i] == f"Head & line {i}\nFirst boldword of {i}\nSecond part\nThird"
    assert text[90] == text[91] == "" and text[92] == "Only this" and text[93] == "cut off &am"
    assert html_text.main_text(pages.filter("false")).count() == 0


def test_templates_group_tokens_by_vector(spark):
    rows = [(i, "h", f"<html><body><div class=top></div><div class=mid><p>{'word ' * 30}{i}</p></div><div class=end>x</div>{'<i></i>' * i}</body></html>") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, host string, html string")
    classes = html_text.equivalence_classes(html_text.token_vectors(pages)).collect()
    root = next(c for c in classes if c["root"])
    assert [t["token"] for t in root["tokens"]] == ["html", "body", "div[class=top]", "div[class=mid]", "p", "div[class=end]"]
    assert html_text.templates(pages).first()["region"] == "p"


PLAIN = "<html><body><div class=menu>Home News</div><div class=content><h2>Head {0}</h2><p>{1}</p><p>{1} {0}</p></div><div class=end>Bye {0}</div></body></html>"


def test_odd_pages_leave_the_template(spark):
    long = sentence(1)
    rows = [(i, "http://h.example/", PLAIN.format(i, long)) for i in range(5)]
    odd = [(10, None), (11, ""), (12, "no tags"), (13, "<html><body><div class=menu>Home News</div><p>cut"), (14, "<article><p>odd")]
    pages = spark.createDataFrame(rows + [(i, "http://h.example/", x) for i, x in odd], "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    for i in range(5):
        assert text[i] == f"Head {i}\n{long}\n{long} {i}"
    assert [text[i] for i in (10, 11, 12, 14)] == ["", "", "no tags", "odd"]


def test_constant_slots_are_the_template(spark):
    page = "<html><body><article><h1>T {0}</h1><div class=box><span class=i></span><p>Join the club</p></div><p>Same words everywhere</p><p>Body {0}</p>{1}</article></body></html>"
    extra = "<div class=strip><i class=a></i><b class=b></b>Read on</div>"  # a class that only some pages have nests in the article
    rows = [(i, "http://h.example/", page.format(i, extra * (i % 2))) for i in range(8)]
    rows += [(i, "http://copies.example/", page.format(0, extra)) for i in range(20, 26)]  # copies tell nothing apart
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    for i in range(8):
        assert text[i] == f"T {i}\nSame words everywhere\nBody {i}"
    assert text[20] == "T 0\nJoin the club\nSame words everywhere\nBody 0\nRead on"
    swapped = html_text.Page("<body><div class=b></div><div class=a>x</div></body>")
    assert swapped.text([{"region": "div[class=b]", "template": ["body", "div[class=a]", "div[class=b]"]}]) == "x"


def test_inline_parts_are_judged_by_run():
    page = """<article><p><span class=share>Share</span> Real text<p>See <a class=related>that</a> and <b>th</b>is<span class="ad">Buy</span>.
<p><button>Play</button><p><math><mi>x</mi></math> is &lt; <svg><text>ten</text></svg><object>seen</object></article>"""
    assert html_text.Page(page).text(None) == "Real text\nSee and this.\nx is < tenseen"


def test_headers_and_anchors_of_an_article():
    page = """<body><header class=top>Site</header><article><header class="entry-header"><h1>Title</h1><nav>Up</nav></header><div class="article-header">Lead</div>
<h2 id=related-work>Related work</h2><section id=notices>Notices</section><p id=comments-on-x>On x<div id=search-results>Results</div>
<div id=comments>Nice</div><section class=comments>Nice</section><div class="page-header cookie">Cookies</div></article></body>"""
    assert html_text.Page(page).text(None) == "Title\nLead\nRelated work\nNotices\nOn x\nResults"
    assert html_text.Page("<body><header>Site</header><p>Text").text([{"region": "body", "template": ["body", "header", "p"]}]) == "Text"


def test_names_of_several_words_and_teasers():
    page = """<body><div class="search-story"><article><p>Long article text, more than its neighbours hold.</p><div class="cookie-bar">Cookies</div>
<div class="ad-slot">Buy</div><p class="story-ad-free">Kept</p></article></div><article class=teaser><p>Short</p></article><div class="site-footer">Foot</div></body>"""
    assert html_text.Page(page).text(None) == "Long article text, more than its neighbours hold.\nKept"


def test_forms_around_a_page_are_no_forms(spark):
    inner = "<div class=top>Home</div><div class=c%s><h2>Head {0}</h2><p>Body of number {0}, which is long enough to be prose and no label of any field.</p><p>{1}</p></div>"
    for wrapper in ("<article>%s</article>" % (inner % 1), inner % 1 + "<p>" + sentence(5) + "</p>"):
        page = f"<html><body><form id=aspnet><input type=hidden name=v><input name=q>{wrapper}</form></body></html>"
        rows = [(i, "http://h.example/", page.format(i, sentence(i))) for i in range(6)] + [(9, "http://single.example/", page.format(9, sentence(9)))]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        for r in html_text.main_text(pages).collect():
            i = r["page_id"]
            assert f"Head {i}\nBody of number {i}, which is long enough to be prose and no label of any field.\n{sentence(i)}" in r["text"], r
    asked = "<p>Body text</p><form class=x><p>Your address will not be published. Required fields are marked with a star.</p><input name=a><input name=b><p>Name</p></form>"
    assert html_text.Page(asked).text(None) == "Body text" == html_text.Page(f"<article>{asked}</article>").text(None)
    assert html_text.Page("<form class=search><article><p>In a search form</p></article></form>").text(None) == "In a search form"


def test_all_articles_of_a_page_stay():
    page = "<body><article><p>" + "long " * 60 + "</p></article><article><h2>Second</h2><p>Short.</p></article></body>"
    assert html_text.Page(page).text(None) == ("long " * 60).strip() + "\nSecond\nShort."


def test_names_do_not_empty_a_page():
    assert html_text.Page("<body><nav>Up</nav><article class=search><h1>A</h1><p>Text</p><nav>Next</nav></article></body>").text(None) == "A\nText"
    assert html_text.Page("<div class=related><article>Text<aside>x</aside></article></div>").text(None) == "Text"
    assert html_text.Page("<div class=related><article>Teaser</article></div><main>Main</main>").text(None) == "Main"
    assert html_text.Page("<div class=comments><article class=comment-body>Nice</article></div>").text(None) == ""


def test_pages_read_singly_lose_menus_and_comments():
    menu = "<div class=m1><a href=a>Home</a> | <a href=b>News from here</a> | <a href=c>About</a></div>"
    rest = '<div id="comments-section">Nice</div><div id="sidebar-left">Left</div><div class="user-reviews">Good</div><div class="reader-comments">So</div>'
    body = "<div class=k><p>Text with <a href=x>one link</a>.</p><ul><li>An item of the text itself</li><li>And <a href=y>another</a></li></ul></div>"
    assert html_text.Page(f"<body>{menu}{body}{rest}</body>").text(None) == "Text with one link.\nAn item of the text itself\nAnd another"
    assert html_text.Page(f"<body><article>{menu}{body}</article></body>").text(None).startswith("Home | News from here | About\nText")


def test_deep_pages_take_linear_time():
    import time

    def took(n):
        began = time.process_time()
        p = html_text.Page("<div class=a><b>x" * n)
        assert p.text(None).count("x") == n and p.below()[0][0] == n and len(p.slot_texts()["div[class=a]"]) == 2 * n - 1
        return time.process_time() - began

    took(100)
    assert took(16_000) < 12 * took(2_000) + 0.5


@pytest.mark.parametrize("case", ["spread", "alike"])
def test_top_products(spark, case):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 8)) * rng.lognormal(0, 1.5, (700, 1)) if case == "spread" else rng.normal(size=(700, 8))
    x = x.astype(np.float32)
    x[60:120] = x[60]
    x[5] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 8), (800, None), (850, [float("nan")] + [0.0] * 7), (851, [None] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("x", "length", "block", "rank", "score", "ids")})
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = []
    for i in range(0, 700, 50):
        best = sorted(((-int(q[i] @ q[j]), j) for j in range(700) if j != i))[:5]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert by_id(retrieval.top_products(df), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert retrieval.top_products(df.filter("false")).count() == 0


def test_products_of_odd_vectors(spark):
    big = [3.0e13, -1.0]
    rows = [(0, []), (50, []), (1, []), (100, [1.0, 2.0]), (2, [0.5, 0.5]), (3, big), (4, [1.0]), (150, [2.0]), (200, [1.0, 2.0, 3.0])]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_id(retrieval.top_products(frame(rows)), "query_id", "rank", "vec_id", "score")
    a = 256 * int(3e13)
    want = [(0, 1, 1, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0), (100, 1, 3, 256 * a - 2 * 256 * 256), (100, 2, 2, 128 * 256 + 128 * 512), (150, 1, 4, 512 * 256)]
    assert got == sorted(want, key=repr)
    for bad in ([1e300, 1.0], [9.0e15, 9.0e15]):
        with pytest.raises(Exception, match="64 bits"):
            retrieval.top_products(frame([(0, bad), (1, bad), (2, [1.0, 1.0])])).collect()


def test_far_buckets_are_not_shipped(spark):
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(size=(1200, 4)) * 100, rng.normal(size=(4000, 4)) * 0.001]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = retrieval.top_products(frame, F.col("vec_id") < 3)
    q = np.floor(256 * x).astype(np.int64)
    want = []
    for i in range(3):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(len(x)) if j != i)[:5]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert by_id(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_both_prunings_keep_all_hits():
    rng = np.random.default_rng(2)
    v, q = rng.integers(-100, 100, (400, 6)), rng.integers(-100, 100, (30, 6))
    for share in (0.2, 0.7, 0.95):
        top = (q @ v.T).max(1)
        least = np.where(top > 0, (share * top).astype(np.int64), top)
        got = set(zip(*(x.tolist() for x in retrieval.meet(np.arange(1000, 1030), q, least, np.arange(400), v, 400)[:2])))
        s = q @ v.T
        assert got == {(1000 + i, j) for i in range(30) for j in range(400) if s[i, j] >= least[i]}


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near_classes(rows, percent=85):
    sets = {}
    for i, x in rows:
        sets.setdefault(i, []).append(shingles(x))
    parent = {i: i for i in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in parent:
        for j in parent:
            for a in sets[i]:
                for b in sets[j]:
                    if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                        x, y = root(i), root(j)
                        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}, sets


def test_near_duplicates(docs, none):
    comp, sets = near_classes(ROWS)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        i = r["doc_id"]
        assert r["n_shingles"] in {len(s) for s in sets[i]}
        assert (r["component_id"], r["kept"]) == ((None, True) if i is None else (comp[i], comp[i] == i))
    assert near_dedup.near_duplicates(none).count() == 0


def test_short_texts_of_one_pattern_meet_by_their_rarest_shingle(spark):
    """Each has a shingle that all have and one of its own; no two are linked, and none is paired with all others."""
    rows = [(i, f"thank you for your order w{i}") for i in range(3000)] + [(5000 + i, f"thank you for your order w{i}") for i in range(5)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - 5000 if i >= 5000 else i for i, _ in rows}
    each = [(i, i, hash(("a", i)), hash("all")) for i in range(50)] + [(90, 90, hash("b"), hash("c")), (91, 91, hash("b"), hash("c"))]
    sets = spark.createDataFrame([(i, [x & (2**62 - 1), y & (2**62 - 1)]) for i, _, x, y in each], "id long, shingles array<long>")
    members = spark.createDataFrame([(i, c) for i, c, _, _ in each], "id long, component long")
    assert {(r["id"], r["least"]) for r in near_dedup.rarest(members, sets, 85).collect()} == {(90, 90), (91, 90)}


def test_near_duplicate_chains(spark):
    """Neighbours in a chain are linked, its ends are not: hubs cannot find all, blocks must."""
    words = [f"w{i}" for i in range(260)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 120])) for i in range(60)]
    comp, _ = near_classes(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == comp == {i: 0 for i in range(60)}


def test_block_links_find_every_component(monkeypatch, spark):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 40)
    rows = [(i, i % 3, [*range(10 * (i % 4), 10 * (i % 4) + 20), 1000 + i]) for i in range(16)]
    members = spark.createDataFrame([(i, 0, 100 + i, 21) for i, _, _ in rows], "id long, group long, component long, n long")
    sets = spark.createDataFrame([(i, s) for i, _, s in rows], "id long, shingles array<long>")
    links = [(r["a"], r["b"]) for r in near_dedup.block_links(members, sets, 85).collect()]
    assert all(a % 4 == b % 4 for a, b in links)
    parent = list(range(16))
    for a, b in links:
        x, y = min(parent[a], parent[b]), max(parent[a], parent[b])
        parent = [x if p == y else p for p in parent]
    assert len(set(parent)) == 4


def test_sketches_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.r_[a[:360], rng.integers(0, 2**63, 40).astype(np.uint64)]
    s = near_dedup.sketches(np.r_[np.unique(a), np.unique(b)], np.array([0, len(np.unique(a)), len(np.unique(a)) + len(np.unique(b))]), 1024)
    assert abs((s[0] == s[1]).mean() - 360 / 440) < 0.05 and (s != np.iinfo(np.uint64).max).all()
    few = near_dedup.sketches(np.arange(3, dtype=np.uint64), np.array([0, 3]), 128)
    assert (few != np.iinfo(np.uint64).max).all()


def test_pieces_equal_the_library(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    t, lib = pieces.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(8)
    parts = ["a", "e", "th", "ing", " ", "  ", "    ", "\n", "日", "é", "☃", "1", "00", "▁", "\t", "==", "b", "S", "'", "<s>", "<0x41>", "\x00"]
    for _ in range(1500):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        ids = t.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(x), repr(x)
        assert t.decode(ids) == x.replace("▁", " ")
    rows = pieces.decode_pieces(pieces.encode_pieces(docs)).collect()
    assert len(rows) == len(ROWS)
    text = {r["doc_id"]: r for r in rows}
    for i, x in ROWS:
        want = np.array(lib.encode(x or ""), "<u4")
        assert (text[i]["text"], text[i]["n_ids"], text[i]["ids_crc32"]) == (x or "", len(want), zlib.crc32(want.tobytes()))
    assert pieces.decode_pieces(pieces.encode_pieces(none)).count() == 0


def verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_url_filter(spark):
    urls = [None, "", "com/en/", "http://com/en/7", "HTTP://A.Example.COM/en/70?x=1#y", "https://example.com/en/8", "x://net/de/", "x://b.example.net/de/81", "x://notexample.com/en/7", "x://org/es", "x://org?/es/", "x://a.org/es/#://com/en/", "a://b://com/en/", "x://COM:80/en/", "x://.com/en/\nz"]
    urls += [f"http://h{i}.{t}/{p}/{i}" for i in range(60) for t in ("com", "net", "org", "example.com") for p in ("en", "de", "es")]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, None)], "page_id long, url string").withColumns({c: F.lit(1) for c in ("keys", "key", "rule", "host", "hit")})
    got = {r["page_id"]: tuple(r)[1:] for r in url_filters.url_filter(pages).collect()}
    assert got == {i: verdict(u, url_filters.RULES) for i, u in enumerate(urls)}
    assert url_filters.url_filter(pages.filter("false")).count() == 0
    assert {r["verdict"] for r in url_filters.url_filter(pages, []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filters.url_filter(pages, [("block", "com", "/"), ("allow", "com", "/")])


def test_rules_of_the_contract(spark):
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{v} {h}{p}" for v, h, p in url_filters.RULES] == contract.split(", ")
    urls = ["x://a.net/de/1", "x://example.net/de/7", "x://b.example.net/de/81", "x://other.net/de/8", "x://a.com/en/7", "x://example.com/en/7", "x://org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r["verdict"] for r in url_filters.url_filter(pages).sort("page_id").collect()]
    assert got == ["allow", "allow", "block", "allow", "block", "allow", "block"]


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("crc32(cast(key as binary)) % 40 = 0")
    levels = url_filters.build_cascade(listed, listed.count(), universe, 20_000)
    wrong = universe.join(listed.withColumn("l", F.lit(True)), "key", "left").filter(url_filters.is_listed(levels, F.col("key")) != F.coalesce("l", F.lit(False)))
    assert len(levels) > 1 and wrong.count() == 0


def test_language_spans(spark):
    english = ["the house is under the old tree", "water and wind walk with the birds", "they think that this is the best thing"] * 6
    german = ["das Haus steht unter dem alten Baum", "Wasser und Wind gehen mit den Vögeln", "sie glauben dass dies das Beste ist"] * 6
    greek = ["το σπίτι είναι κάτω από το δέντρο"] * 6
    train = [(i, x, g) for i, (x, g) in enumerate([(x, "en") for x in english] + [(x, "de") for x in german] + [(x, "el") for x in greek])]
    model = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), "text", "lang")
    mixed = " ".join(english[:3]) + " " + " ".join(german[:3])
    rows = [(1, mixed), (2, None), (3, ""), (4, "12 …!"), (5, "το δέντρο"), (6, "das alte Haus"), (6, "das alte Haus"), (7, "☃☃"), (8, "日本"), (9, "the old house " * 9000)]
    tagged = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit("clash")), model)
    got = {r["doc_id"]: r for r in tagged.collect()}
    assert [s["lang"] for s in got[1]["lang_spans"]] == ["en", "de"]
    cut = got[1]["lang_spans"][1]["start"]
    assert mixed.encode()[cut : cut + 8] == b"das Haus"
    assert {i: got[i]["lang_pred"] for i in (2, 3, 4, 5, 6, 7, 9)} == {2: "und", 3: "und", 4: "und", 5: "el", 6: "de", 7: "und", 9: "en"}
    assert got[8]["lang_pred"] in model["langs"] and 0 <= got[8]["lang_score"] <= 1
    assert tagged.count() == len(rows) and language_id.identify(tagged.filter("false"), model).count() == 0
    empty = language_id.fit(spark.createDataFrame([], "text string, lang string"), "text", "lang")
    assert {r["lang_pred"] for r in language_id.identify(tagged, empty).collect()} == {"und"}


def test_viterbi_equals_all_labellings():
    rng = np.random.default_rng(9)
    for sizes in ([3, 1, 0, 6], [7], [1]):
        first = np.r_[0, np.cumsum(sizes)]
        s = rng.normal(size=(first[-1], 3)) * 3
        labels = language_id.viterbi(s, first, 2.0)
        for a, b in zip(first, first[1:]):
            if a < b:
                value = lambda x: s[np.arange(a, b), x].sum() - 2.0 * (np.diff(x) != 0).sum()  # noqa: E731, B023
                grid = np.stack(np.meshgrid(*[range(3)] * (b - a)), -1).reshape(-1, b - a)
                assert abs(max(value(g) for g in grid) - value(labels[a:b])) < 1e-9
    long = rng.normal(size=(200, 2))
    labels = language_id.viterbi(long, np.array([0, 200]), 1.5)
    d, back = np.zeros(2), []
    for t in range(200):
        stay = d >= d.max() - 1.5
        back.append(np.where(stay, [0, 1], d.argmax()))
        d = np.where(stay, d, d.max() - 1.5) + long[t]
    assert abs(d.max() - (long[np.arange(200), labels].sum() - 1.5 * (np.diff(labels) != 0).sum())) < 1e-9


def test_viterbi_of_many_languages_and_small_transfers(monkeypatch):
    rng = np.random.default_rng(12)
    first = np.array([0, 70, 70, 71, 300])
    scores = rng.normal(size=(300, 130)) * 2
    want = language_id.viterbi(scores, first, 3.0)
    assert want.max() > 127 and want.min() >= 0
    monkeypatch.setattr(language_id, "TRANSFER_BYTES", 8 * 130 * 130 * 3)
    assert (language_id.viterbi(scores, first, 3.0) == want).all()
    for a, b in zip(first, first[1:]):
        d = np.zeros(130)
        for t in range(a, b):
            d = np.maximum(d, d.max() - 3.0) + scores[t]
        if b > a:
            got = scores[np.arange(a, b), want[a:b]].sum() - 3.0 * (np.diff(want[a:b]) != 0).sum()
            assert abs(d.max() - got) < 1e-9


def test_letters_count_once_and_symbols_are_none(spark):
    train = [("the old house stands under the tree by the water", "en"), ("старый дом стоит под деревом у воды", "ru")] * 5
    model = language_id.fit(spark.createDataFrame(train, "text string, lang string"), "text", "lang")
    rows = [(1, "the old house stands под дом стоит"), (2, "€ — … ✓ 🎉 « » × 、"), (3, "— the — house —")]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1]["lang_pred"] == "en" and abs(got[1]["lang_score"] - 17 / 28) < 1e-9
    assert got[2]["lang_pred"] == "und" and got[2]["lang_spans"] == [] and got[3]["lang_pred"] == "en"


def test_held_out_accuracy(spark):
    got = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    share = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share > 0.98


def test_registered_queries():
    assert set(SQL) <= set(QUERIES) and {re.match(r"op\d+_", n)[0] for n in QUERIES} == {f"op{i}_" for i in range(1, 11)}
