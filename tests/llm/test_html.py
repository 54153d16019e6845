import random
import re
from collections import Counter
from html import unescape

import numpy as np

from quern.llm import html as H
from quern.llm.common import table


def plain_article(page):
    body = re.search(r"(?s)<article>(.*?)</article>", page or "<article></article>").group(1)
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)[^>]*>", body)]
    return "\n".join(b for b in blocks if b)


def test_op5_equals_articles(spark, sf_dir):
    pages = {r.page_id: r for r in table(spark, sf_dir, "pages").collect()}
    rows = H.op5_main_text(spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.text == plain_article(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def test_suffix_array_equals_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 30, 200):
        for letters in (1, 2, 5):
            s = [rng.randrange(letters) for _ in range(n)] + [99]  # no suffix is a prefix of another
            order, shared = H.suffix_array(np.array(s))
            want = sorted(range(len(s)), key=lambda i: s[i:])
            assert order.tolist() == want
            for k in range(1, len(s)):
                a, b = s[want[k - 1] :], s[want[k] :]
                assert shared[k] == next(i for i in range(len(b) + 1) if a[: i + 1] != b[: i + 1])


def test_shared_runs_equal_definition():
    rng = random.Random(2)
    run = list(range(100, 110))
    streams = [[rng.randrange(40) for _ in range(rng.randrange(30))] for _ in range(12)]
    for s in streams[:5]:
        s[len(s) // 2 : len(s) // 2] = run
    streams += [[], [1] * 50, [1, 2, 3]]
    page, begin, pages = H.shared_runs([np.array(s, np.int64) for s in streams], 4)
    got = {tuple(streams[p][b : b + 4]): n for p, b, n in zip(page.tolist(), begin.tolist(), pages.tolist())}
    want = Counter(x for s in streams for x in {tuple(s[i : i + 4]) for i in range(len(s) - 3)})
    assert got == want and len(page) == len(want)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a>b">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="adSlot1">Buy</div>{main}<aside>More</aside>
<form><label>Mail</label><input name=x></form><section id="comments"><p>First!</p></section><footer>(c) me</footer></body></html>"""


def test_structure():
    main = """<article class="post"><header><h2>A   &lt;title&gt;</h2></header><p>One <b>bo</b>ld&nbsp;word
    <p>Two<!-- <p>hidden --></p><div class="share-buttons">Tweet</div><ul><li>x<li>y</ul><blockquote>Q</blockquote>
    <div class="comments"><article class="comment">Nice</article></div><p hidden>h</p></article>"""
    assert H.main_texts([PAGE.format(main=main)]) == ["A <title>\nOne bold word\nTwo\nx\ny\nQ"]


def test_repeated_boilerplate_without_landmarks():
    pages = []
    for i in range(6):
        own = " ".join(f"unique{i}_{j}" for j in range(30))
        pages.append(PAGE.format(main=f"<div>read all the best stories of the day right here</div><div>{own}</div>"))
    assert H.main_texts(pages) == [" ".join(f"unique{i}_{j}" for j in range(30)) for i in range(6)]


def test_boilerplate_of_large_hosts(spark):
    """Runs count over all pages of a host: rare ones of a large host, and those of a host's last pages."""
    rows, want = [], {}
    line = "read all the best stories of the day right here"
    for host, pages, some in (("a", 1000, 125), ("b", 257, 1), ("c", 2, 1), ("d", 40, 7)):
        for i in range(pages):
            own = " ".join(f"unique{host}{i}x{j}" for j in range(30))
            want[len(rows)] = own if host != "c" else f"{line}\n{own}"
            rows.append((len(rows), f"http://{host}/{i}", PAGE.format(main=(f"<div>{line}</div>" if i % some == 0 else "") + f"<div>{own}</div>")))
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    assert {r.page_id: r.text for r in H.extract_main_text(docs).collect()} == want
    few = [r[2] for r in rows if "//d/" in r[1]]
    assert H.main_texts(few) == [want[r[0]] for r in rows if "//d/" in r[1]]


def test_names_inside_articles_only_hint():
    """Unique blocks with such names stay, blocks that pages of the host repeat go."""
    body = """<article><p>{own}</p><div class="search">{a}</div><section class="related-work">{b}</section><div id="social-science">{c}</div>
    <label>{d}</label><div class="ad-slot">buy {own}</div><div class="related">{line}</div></article>"""
    line = "read all the best stories of the day right here"
    pages = [PAGE.format(main=body.format(line=line, **{k: " ".join(f"{k}{i}x{j}" for j in range(12)) for k in ("own", "a", "b", "c", "d")})) for i in range(4)]
    want = ["\n".join(" ".join(f"{k}{i}x{j}" for j in range(12)) for k in ("own", "a", "b", "c", "d")) for i in range(4)]
    assert [t.replace("\n", " ") for t in H.main_texts(pages)] == [w.replace("\n", " ") for w in want]


def test_names_outside_articles():
    page = """<body><div class="has-sidebar"><div class="advert-300x250">a</div><div class="newsletter-optin">b</div><p class="menu-item-7">c</p>
    <div class="top-nav2">d</div><div class="related-work">the text of the page</div><div class="content-header">e</div></div></body>"""
    assert H.main_texts([page]) == ["the text of the page"]


def test_teasers_do_not_hide_the_body(spark):
    """Bodies outside landmarks, several articles, and a template outside: through Spark and through ``main_texts``."""
    line = "read all the best stories of the day right here"
    own = [" ".join(f"own{i}x{j}" for j in range(60)) for i in range(8)]
    pages = [PAGE.format(main=f"<article><p>teaser {i}</p></article><div>{line}</div><div>{own[i]}</div>") for i in range(4)]
    pages += [PAGE.format(main=f"<div>{line}</div><article><p>{own[i]}</p></article><article><p>second {i}</p></article><div>aside {i}</div>") for i in range(4, 8)]
    want = [f"teaser {i}\n{own[i]}" for i in range(4)] + [f"{own[i]}\nsecond {i}" for i in range(4, 8)]
    assert H.main_texts(pages) == want
    docs = spark.createDataFrame([(i, "http://h/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    assert [r.text for r in sorted(H.extract_main_text(docs).collect())] == want


def test_unmatched_tags_are_fast():
    import time

    began = time.perf_counter()
    H.page_blocks("<div>" * 20_000 + "</p></span>" * 20_000)
    assert time.perf_counter() - began < 2


def test_articles_of_copies_are_kept():
    page = PAGE.format(main="<article><p>the very same words on every page of this host, many times over</p></article>")
    assert H.main_texts([page] * 5) == ["the very same words on every page of this host, many times over"] * 5


def test_broken_markup():
    for page in (None, "", "plain text", "<", "<p", "<p class='x", "a < b > c", "<script>never closed", "<!-- open", "</p></div>", "<p>" * 3000 + "x", "<b><i><p>a</b>b", "&#x110000; &bogus; &#0;"):
        H.main_texts([page])
    assert H.main_texts(["a < b and <i>c</i>"]) == ["a < b and c"]
    assert H.main_texts([None, ""]) == ["", ""]


def test_edge_cases(spark):
    good = PAGE.format(main="<article><p>text of the page</p></article>")
    rows = [(1, None, good, "a"), (2, "http://h/x", None, None), (2, "http://h/x", None, None), (None, "odd url", good, "b"), (3, "HTTP://H/y", "", None), (4, "http://h/", PAGE.format(main="<main>" + "word " * 200_000 + "</main>"), None)]
    got = H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text[:9]) for r in got) == [(0, "text of t"), (1, "text of t"), (2, ""), (2, ""), (3, ""), (4, "word word")]
    assert H.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LINE = "read all the best stories of the day right here"


def words(name, n):
    return " ".join(f"{name}x{j}" for j in range(n))


def by_definition(pages):
    """The whole rule over one host, from a dictionary of runs instead of a suffix array."""
    parsed = [H.page_blocks(p) for p in pages]
    streams = [[[f"<{tag}>", *([text] if zone == H.ARTICLE else text.split(" "))] for tag, text, zone in blocks] for blocks in parsed]
    flat = [[t for block in s for t in block] for s in streams]
    runs = Counter(r for f in flat for r in {tuple(f[i : i + 6]) for i in range(len(f) - 5)})
    out = []
    for blocks, stream, tokens in zip(parsed, streams, flat):
        counts = [max([runs[tuple(tokens[i : i + 6])] for i in range(max(0, k - 5), min(k, len(tokens) - 6) + 1)], default=1) for k in range(len(tokens))]
        repeats, sizes, at = [], [], 0
        for (_, text, zone), block in zip(blocks, stream):
            own = sorted(counts[at : at + len(block)], reverse=True)
            repeats.append(1 if zone == H.ARTICLE else next(n for n in sorted(set(own), reverse=True) if sum(c >= n for c in own) >= len(own) / 2))
            sizes.append(len(block) if zone != H.ARTICLE else len(text.split(" ")) + 1)
            at += len(block)
        most = min((n for n in repeats if sum(s for r, s in zip(repeats, sizes) if r <= n) >= sum(sizes) / 5), default=1)
        stays = [(text, zone, s) for (_, text, zone), n, s in zip(blocks, repeats, sizes) if n <= 2 * most]
        outside = sum(s for _, z, s in stays if z == H.OPEN) > sum(s for _, z, s in stays if z != H.OPEN)
        out.append("\n".join(t for t, z, _ in stays if z != H.OPEN or outside))
    return out


def spark_texts(spark, pages):
    docs = spark.createDataFrame([(i, "http://h/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    return [r.text for r in sorted(H.extract_main_text(docs).collect())]


def test_copies_without_a_landmark_stay(spark):
    for copies in (2, 3, 300):
        pages = [PAGE.format(main=f"<div>{words('a', 80)}</div><div>{words('b', 20)}</div>")] * copies
        assert H.main_texts(pages) == spark_texts(spark, pages) == [words("a", 80) + "\n" + words("b", 20)] * copies


def test_copies_lose_what_all_the_host_repeats(spark):
    pages = [PAGE.format(main=f"<div>{LINE}</div><div>{words('a', 80)}</div>")] * 3 + [PAGE.format(main=f"<div>{LINE}</div><div>{words(f'p{i}', 40)}</div>") for i in range(20)]
    want = [words("a", 80)] * 3 + [words(f"p{i}", 40) for i in range(20)]
    assert H.main_texts(pages) == spark_texts(spark, pages) == by_definition(pages) == want


def test_shared_articles_stay(spark):
    """Three pages with one article and headlines of their own, and a fourth that shares most sentences."""
    body = "".join(f"<p>{words(f's{k}', 25)}</p>" for k in range(8))
    pages = [PAGE.format(main=f"<h2>headline {i} of the day</h2>{body}") for i in range(3)]
    pages.append(PAGE.format(main="<h2>another</h2>" + "".join(f"<p>{words(f's{k}', 25)}</p>" for k in range(6)) + f"<p>{words('z', 25)}</p>"))
    own = [words(f"s{k}", 25) for k in range(8)]
    want = ["\n".join([f"headline {i} of the day", *own]) for i in range(3)] + ["\n".join(["another", *own[:6], words("z", 25)])]
    assert H.main_texts(pages) == spark_texts(spark, pages) == by_definition(pages) == want


def test_whole_rule_equals_definition(spark):
    rng = random.Random(5)
    for _ in range(4):
        shared = [words(f"q{k}", rng.randrange(3, 30)) for k in range(6)]
        pages = []
        for i in range(rng.randrange(2, 14)):
            parts = [f"<{t}>{rng.choice(shared) if rng.random() < 0.5 else words(f'n{i}y{k}', rng.randrange(1, 25))}</{t}>" for k, t in enumerate(rng.choices(["div", "p", "article", "li"], k=rng.randrange(0, 6)))]
            pages.append(PAGE.format(main="".join(parts)))
        pages += pages[:2]
        assert H.main_texts(pages) == spark_texts(spark, pages) == by_definition(pages)


def repeats_by_definition(streams):
    """For each page and block the number of pages that have half of its tokens in runs of six, from a dictionary."""
    flat = [[t for block in s for t in block] for s in streams]
    runs = Counter(r for f in flat for r in {tuple(f[i : i + 6]) for i in range(len(f) - 5)})
    out = []
    for stream, tokens in zip(streams, flat):
        counts = [max([runs[tuple(tokens[i : i + 6])] for i in range(max(0, k - 5), min(k, len(tokens) - 6) + 1)], default=1) for k in range(len(tokens))]
        ends = np.cumsum([len(b) for b in stream], dtype=int).tolist()
        out.append([sorted(counts[end - len(b) : end], reverse=True)[(len(b) + 1) // 2 - 1] for b, end in zip(stream, ends)])
    return out


def verdicts_by_definition(pages):
    """(n_repeated, n_template) of each page of one host."""
    parsed = [H.all_blocks(p) for p in pages]
    tokens = lambda tag, text, one: [f"<{tag}>", *([text] if one else text.split(" "))]
    is_open = [any(z in (H.OPEN, H.HINTED) for _, _, z in blocks) for blocks in parsed]
    left_open = [[(i, tokens(tag, x, z == H.ARTICLE)) for i, (tag, x, z) in enumerate(blocks) if z != H.RULED_OUT and some] for blocks, some in zip(parsed, is_open)]
    marked = [[(i, tokens(tag, x, False)) for i, (tag, x, z) in enumerate(blocks) if z in (H.ARTICLE, H.RULED_OUT)] for blocks in parsed]
    repeats = [[1] * len(blocks) for blocks in parsed]
    for streams in (left_open, marked):  # what an article's blocks are in ``marked`` counts
        for page, found, stream in zip(repeats, repeats_by_definition([[b for _, b in s] for s in streams]), streams):
            for (i, _), n in zip(stream, found):
                page[i] = n
    out = []
    for blocks, page, text in zip(parsed, repeats, by_definition(pages)):
        own = sorted(n for (_, x, z), n in zip(blocks, page) if z != H.RULED_OUT for _ in range(len(x.split(" ")) + 1))
        level = own[max(0, -(-len(own) // 5) - 1)] if own else 1
        repeated = [x for (_, x, z), n in zip(blocks, page) if z == H.ARTICLE and n > 2 * level]
        assert all(x in text.split("\n") for x in repeated)
        out.append((sum(map(len, repeated)), sum(z == H.RULED_OUT and n > 2 * level for (_, _, z), n in zip(blocks, page))))
    return out


def spark_verdicts(spark, pages, host="h"):
    docs = spark.createDataFrame([(i, f"http://{host}/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(5)
    return [(r.n_repeated, r.n_template) for r in sorted(H.extract_main_text(docs).collect())]


def test_array_is_asked_about_articles_and_boilerplate(spark):
    """Markup decides all blocks of these pages; the array still says which of them the host repeats, and articles stay whole."""
    page = """<body><nav><ul><li>Home</li><li>News of today</li></ul></nav><div class="ad">{ad}</div>
    <article><h1>{title}</h1><p>{own}</p><p>{line}</p></article><footer>all rights reserved by the host of these pages</footer></body>"""
    pages = [page.format(ad=words(f"ad{i}", 9), title=f"title {i}", own=words(f"own{i}", 40), line=LINE) for i in range(9)]
    assert spark_texts(spark, pages) == [f"title {i}\n{words(f'own{i}', 40)}\n{LINE}" for i in range(9)]
    assert spark_verdicts(spark, pages) == verdicts_by_definition(pages) == [(len(LINE), 3)] * 9
    assert spark_verdicts(spark, pages[:1] * 9) == verdicts_by_definition(pages[:1] * 9) == [(0, 0)] * 9


def test_verdicts_equal_definition(spark):
    rng = random.Random(9)
    for _ in range(2):
        shared = [words(f"q{k}", rng.randrange(3, 30)) for k in range(5)]
        some = lambda i, k: rng.choice(shared) if rng.random() < 0.5 else words(f"n{i}y{k}", rng.randrange(1, 25))
        pages = []
        for i in range(12):
            parts = [f"<{t}>{some(i, k)}</{t.split(' ')[0]}>" for k, t in enumerate(rng.choices(["p", "article", "article", "aside", "div class='ad'", "footer"], k=rng.randrange(0, 8)))]
            pages.append(PAGE.format(main="".join(parts)))
        pages += pages[:2] + [""]
        assert spark_verdicts(spark, pages) == verdicts_by_definition(pages)
        assert H.main_texts(pages) == spark_texts(spark, pages) == by_definition(pages)


def test_ruled_out_blocks_end_with_their_element():
    blocks = H.all_blocks("<p>a <b>b<span class='ad'>c</b>d <i hidden>e</i>f</p><nav>g<div>h</nav>i<script>j</script>")
    assert [(x, z == H.RULED_OUT) for _, x, z in blocks] == [("a b", False), ("c", True), ("d", False), ("e", True), ("f", False), ("g", True), ("h", True), ("i", False)]


def test_hashes_of_words_are_distinct():
    import pyarrow as pa

    strings = ["", "a", "b", "a" * 7, "a" * 8, "a" * 9, "a" * 16, "a" * 17, "ab" * 8, "ba" * 8, "\0", "\0\0", "é", "e", "x" * 5000, "x" * 4999 + "y", "y" + "x" * 4999]
    strings += [f"{a}{b}" for a in ("", "prefix-", "longer-prefix-") for b in range(20_000)]
    hashes = H._hashed(pa.array(strings + strings[::-1]))
    assert len(set(hashes.tolist())) == len(strings) and (hashes == hashes[::-1]).all()
    assert (H._hashed(pa.array(["zz", *strings]).slice(1)) == hashes[: len(strings)]).all()


def test_op5_asks_the_array(spark, sf_dir):
    """Every page of the query against the definition, host by host; hosts of the smallest table have too few pages to repeat anything."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    hosts = {}
    for r in table(spark, sf_dir, "pages").collect():
        hosts.setdefault(re.match(r"\w+://([^/?#]*)", r.url)[1].lower(), []).append(r)
    want = {r.page_id: v for rows in hosts.values() for r, v in zip(rows, verdicts_by_definition([r.html for r in rows]))}
    assert {r.page_id: (r.n_repeated, r.n_template) for r in H.op5_main_text(spark, sf_dir).collect()} == want
    assert any(t for _, t in want.values())
