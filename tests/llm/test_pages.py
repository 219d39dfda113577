import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import pages


def article(html):
    """The article of the test pages' one template, by plain substitution."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", inner.replace("<b>", "").replace("<br>", " "))
    return "\n\n".join(t for t in (" ".join(unescape(p).split()) for p in parts) if t)


def shard(rows, far=None):
    return pages._shard([(k, pages.kept_blocks(h)) for k, h in rows], far)


def keys_of(html):
    words = [t.split(" ") for t, _ in pages.kept_blocks(html)]
    flat = [w for b in words for w in b]
    hashes = np.array([pages._Hashes()[w] for w in flat], np.uint64)
    _, windows, _, whole = pages.marks(hashes, np.array([len(flat)]), np.array([len(b) for b in words]))
    return set(windows.tolist()) | set(whole.tolist())


def test_suffix_array_covers_what_brute_force_covers():
    rng = np.random.default_rng(8)
    streams = [rng.integers(0, 3, rng.integers(0, 60)) for _ in range(12)]
    page = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10])
    got = pages.repeated(streams, page)
    grams = {}
    for p, s in zip(page, streams):
        for i in range(len(s) - pages.LEAST + 1):
            grams.setdefault(tuple(s[i : i + pages.LEAST]), set()).add(int(p))
    want = []
    for s in streams:
        c = [False] * (len(s) + 1)
        for i in range(len(s) - pages.LEAST + 1):
            if len(grams[tuple(s[i : i + pages.LEAST])]) > 1:
                c[i : i + pages.LEAST] = [True] * pages.LEAST
        want += c
    assert got.tolist() == want


def test_repeats_go_and_unique_runs_stay_without_markup():
    menu = " ".join(f"menu{i}" for i in range(12))
    own = [" ".join(f"w{i}x{k}" for k in range(9)) for i in range(4)]
    tail = [" ".join(f"t{i}x{k}" for k in range(9)) for i in range(4)]
    rows = [(i, f"<ul><li>{menu.replace(' ', '<li>')}</ul><div>{own[i]}</div><div>{menu} {tail[i]}</div>") for i in range(4)]
    assert [t for t, _ in shard(rows)] == [f"{own[i]}\n\n{tail[i]}" for i in range(4)]
    # the same page twice is one page: nothing repeats
    assert shard([rows[0], rows[0]])[0][1] == 0


def test_frames_on_many_pages_go_from_articles():
    notice = " ".join(f"notice{i}" for i in range(12))
    quote = " ".join(f"quote{i}" for i in range(12))
    own = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(20)]
    page = lambda i, *parts: (i, "<article>" + "".join(f"<p>{p}</p>" if p[0] != "#" else f"<h2>{p[1:]}</h2>" for p in parts) + "</article>")
    rows = [page(i, own[i], quote, f"closing words {i}", notice) if i < 12 else page(i, notice, own[i]) for i in range(20)]
    # a notice at the end or the beginning goes; what stands inside stays, on most pages too
    assert [t for t, _ in shard(rows)] == [f"{own[i]}\n\n{quote}\n\nclosing words {i}" if i < 12 else own[i] for i in range(20)]
    # headings stay and are no border of the frame
    rows = [page(i, "#" + notice, notice, own[i]) for i in range(20)]
    assert [t for t, _ in shard(rows)] == [f"{notice}\n\n{own[i]}" for i in range(20)]
    # a minority of a host's pages, or few pages, prove nothing
    rows = [page(i, own[i], notice) if i < 9 else page(i, own[i]) for i in range(20)]
    assert shard(rows)[0][0] == f"{own[0]}\n\n{notice}"
    assert shard([page(i, own[i], notice) for i in range(pages.OFTEN - 1)])[0][0] == f"{own[0]}\n\n{notice}"
    # copies of an article, and copies with another end, keep it
    rows = [page(i, own[0], notice) for i in range(20)]
    assert {t for t, _ in shard(rows)} == {f"{own[0]}\n\n{notice}"}
    rows = [page(i, own[0], own[1], f"end{i} of it") for i in range(20)]
    assert [t for t, _ in shard(rows)] == [f"{own[0]}\n\n{own[1]}\n\nend{i} of it" for i in range(20)]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_articles_stay_whole_however_hosts_are_cut(spark, sf, monkeypatch):
    src = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    want = {r.page_id: article(r.html) for r in src.collect()}
    notice = " ".join(f"subscribe{i}" for i in range(12))
    framed = src.withColumn("html", F.replace("html", F.lit("</article>"), F.lit(f"<p>{notice}</p></article>")))
    for df in (src, src.withColumn("url", F.concat(F.lit("http://h"), F.col("page_id") % 2, F.lit(".org/x"))), framed.withColumn("url", F.lit("http://one.org/"))):
        assert {r.page_id: r.text for r in pages.main_text(df).collect()} == want
    # the merged host in many shards
    monkeypatch.setattr(pages, "SHARD_CHARS", 400_000)
    rows = pages.main_text(framed.union(framed.filter("page_id % 5 = 0")).withColumn("url", F.lit("http://one.org/"))).collect()
    assert {r.page_id: r.text for r in rows} == want and len(rows) > len(want)


def test_markup():
    text = lambda h: shard([(1, h)])[0][0]
    assert text("<nav>a</nav><article><h1>T &amp; t</h1><p class='ad'>buy<p>x\n\t y&nbsp;z<br>q<aside>s</aside><div id=comments><p>c</div><form>f</form></article><footer>z</footer>") == "T & t\n\nx y z q"
    assert text("<p>plain<script>if (a<b) '</p>'</script> text</p><!-- no > --><style>p{}</style>") == "plain text"
    assert text("<main><div class='cookie-notice'>k</div><p>m</p></main><p>out</p>") == "m"
    assert text("") == text("<html></html>") == "" and text("no tags &lt;here") == "no tags <here"
    assert text("<p>cut <b") == "cut <b"


def test_hints_spare_articles_and_match_whole_words():
    text = lambda h: shard([(1, h)])[0][0]
    assert text("<body class='page no-sidebar'><p>a</p></body>") == "a"
    assert text("<nav>n</nav><article class='post comments-open'><h2 id='related-work'>h</h2><p>a</p></article><p>o</p>") == "h\n\na"
    assert text("<main id='search-results-explained' class=search><p>a</p></main><div class='ad'>x</div>") == "a"
    assert text("<div role=main class='content widget'><p>a</p></div><p>o</p>") == "a"
    assert text("<h1 class='banner'>h</h1><div class='share-related'>s</div><p class='add comments-closed'>a</p>") == "h\n\na"
    assert text("<body hidden><p>a</p></body>") == "" and text("<nav>n</nav><div class='ad'><footer>f</footer></div>") == ""
    # hints that leave nothing: repetition decides
    menu = " ".join(f"menu{i}" for i in range(12))
    rows = [(i, f"<nav>{menu}</nav><div class='widget'><p>{' '.join(f'w{i}x{k}' for k in range(9))}</p><p>{menu}</p></div>") for i in range(3)]
    assert [t for t, _ in shard(rows)] == [" ".join(f"w{i}x{k}" for k in range(9)) for i in range(3)]


def test_whole_table(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    want = {(p, u): article(h) for p, u, h in rows}
    rows += [(901, None, None), (902, "http://x.y/", ""), (None, "http://x.y/", "<p>t</p>"), (903, "http://x.y/", "<article><p>" + "word " * 60000 + "</article>"), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "html", "1 as _host", "2 as text", "3 as _pages", "4 as _blocks", "'k' as n_chars", "5 as _shards", "6 as _twice", "7 as _id")
    got = pages.main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.url): r.text for r in got}
    assert all(by[k] == t for k, t in want.items())
    assert by[901, None] == by[902, "http://x.y/"] == "" and by[None, "http://x.y/"] == "t" and by[903, "http://x.y/"].count("word") == 60000
    assert pages.main_text(df.limit(0)).count() == 0


def stripped(spark, sf_dir):
    """The table's pages without the elements that name the article and the menus."""
    src = spark.read.parquet(f"{sf_dir}/pages.parquet")
    notice = " ".join(f"subscribe{i}" for i in range(20))
    html = "concat(regexp_replace(html, '</?(article|main|nav|footer|div)[^>]*>', ''), '<p>', '" + notice + "</p>')"
    return src.selectExpr("page_id", "url", f"{html} as html"), notice


def test_repetition_decides_without_markup_and_partitions_do_not_matter(spark, sf_dir, monkeypatch):
    bare, notice = stripped(spark, sf_dir)
    results = []
    for n in (1, 16, 64):
        got = pages.main_text(bare.repartition(n)).collect()
        results.append(sorted((r.page_id, r.url, r.text, r.repeated_tokens) for r in got))
    assert results[0] == results[1] == results[2]
    hosts = {}
    for r in bare.collect():
        hosts.setdefault(re.sub(r"^https?://([^/:?#]+).*", r"\1", r.url), []).append(r.page_id)
    several = {p for v in hosts.values() if len(v) > 1 for p in v}
    texts = {p: t for p, _, t, _ in results[0]}
    assert several and all((notice in t) == (p not in several) for p, t in texts.items())
    # large hosts in many shards: what repeats across shards goes as well
    monkeypatch.setattr(pages, "SHARD_CHARS", 30_000)
    split = [sorted((r.page_id, r.url, r.text) for r in pages.main_text(bare.repartition(n)).collect()) for n in (1, 16)]
    assert split[0] == split[1]
    assert all((notice in t) == (p not in several) for p, _, t in split[0])


def test_texts_do_not_depend_on_the_shards(spark, sf_dir, monkeypatch):
    bare, _ = stripped(spark, sf_dir)
    # runs of 10 words inside blocks, on a page with another each; articles within a frame that is most of them on most pages, and with a frame that isn't
    runs = [" ".join(f"run{i}x{k}" for k in range(10)) for i in range(30)]
    page = lambda i: f"<p>{' '.join(f'u{i}x{k}' for k in range(9))} {runs[i // 2 % 30]} v{i} w{i}</p>" + " ".join(f"fill{i}x{k}" for k in range(60))
    heavy, light = (" ".join(f"{name}{k}" for k in range(n)) for name, n in (("heavy", 40), ("light", 9)))
    inside = lambda i: f"<article><p>{' '.join(f'a{i}x{k}' for k in range(20 if i % 8 else 200))}</p><p>{heavy}</p></article>"
    kept = lambda i: f"<article><p>{' '.join(f'b{i}x{k}' for k in range(50))}</p><p>{light}</p></article>"
    made = [(1000 + i, "http://runs.org/", page(i)) for i in range(60)] + [(2000 + i, "http://heavy.org/", inside(i)) for i in range(48)] + [(3000 + i, "http://light.org/", kept(i)) for i in range(40)]
    df = bare.union(spark.createDataFrame(made + made[:3], "page_id long, url string, html string"))
    whole = sorted(map(tuple, pages.main_text(df).collect()), key=str)
    texts = {r[0]: r[2] for r in whole}
    assert runs[0] not in texts[1000] and all(heavy in texts[2000 + i] for i in range(48)) and not any(light in texts[3000 + i] for i in range(40))
    for chars in (30_000, 3_000):
        monkeypatch.setattr(pages, "SHARD_CHARS", chars)
        assert sorted(map(tuple, pages.main_text(df).collect()), key=str) == whole


def test_far_repeats_equal_brute_force():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(4000)]
    shared = " ".join(rng.choice(words, 40))
    htmls = [f"<p>{' '.join(rng.choice(words, 30))}</p><p>{' '.join(rng.choice(words, 12))} {shared} {' '.join(rng.choice(words, 9))}</p><p>{' '.join(shared.split()[:9])}</p>" for _ in range(6)]
    keys = [keys_of(h) for h in htmls]
    far = {k: sum(k in x for x in keys) for k in set().union(*keys)}
    far = {k: n for k, n in far.items() if n > 1}
    for h in htmls:  # each page a shard of its own
        text, covered = shard([(1, h)], far)[0]
        own = pages.blocks_of(h)[1].text.split()
        # winnowed windows cover all but at most SPREAD - 1 words at each end
        kept = text.split("\n\n")
        assert kept[0] == pages.blocks_of(h)[0].text and len(kept) == 2
        left = kept[1].split()
        assert 21 <= len(left) <= 21 + 2 * (pages.SPREAD - 1) and left[:12] == own[:12] and left[-9:] == own[-9:]
        assert covered == 9 + len(own) - len(left)


def test_marks_do_not_depend_on_the_pages_beside():
    rng = np.random.default_rng(6)
    streams = [rng.integers(0, 9, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (0, 3, 8, 9, 22, 23, 24, 60, 400, 1, 30)]
    sizes = [np.diff(np.unique(np.concatenate([[0, len(x)], rng.integers(0, len(x) + 1, 3)]))) for x in streams]
    alone = [pages.marks(x, np.array([len(x)]), z) for x, z in zip(streams, sizes)]
    at, windows, numbers, whole = pages.marks(np.concatenate(streams), np.array([len(x) for x in streams]), np.concatenate(sizes))
    assert windows.tolist() == [k for a in alone for k in a[1].tolist()] and whole.tolist() == [k for a in alone for k in a[3].tolist()]
    starts = np.cumsum([0] + [len(x) for x in streams])
    assert at.tolist() == [p + o for a, o in zip(alone, starts.tolist()) for p in a[0].tolist()]


def test_odd_markup_is_read_in_linear_time():
    import time

    for piece in ("<a ", "<a title=\"", "<!--", "<b '>\"", "<script>", "<p class='x", "<", "<a \"' >"):
        html = piece * (1_000_000 // len(piece))
        began = time.time()
        pages.blocks_of(html)
        assert time.time() - began < 8, piece
    text = lambda h: shard([(1, h)])[0][0]
    assert text('<p><a title="foo>link</a> end</p>') == "link end"
    assert text("<p>it's <a title='a > b'>x</a> isn't</p>") == "it's x isn't"
    assert text("<p>1 < 2 and <3</p>") == "1 < 2 and <3"
