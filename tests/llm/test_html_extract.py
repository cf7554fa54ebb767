import html
import random
import re
import time

from lendwell.llm import html_extract

NAV = "<nav><ul><li><a href=/a>Home<li><a>News</ul></nav>"


def text(source):
    return html_extract.parse(source).text()


def test_article_only():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header>"
        + NAV
        + "<div class='cookie-notice'>We use</div><main><div class=sidebar>S</div><article><header><h1>A &lt; b&nbsp;c</h1>"
        "</header><p>One<br>two  <b>x</b>\n y<!-- no --><ul><li>a<li>b</ul><form>f</form><div id=comments><p>c</p></div>"
        "<aside>z</aside><p hidden>h<p>Last</article></main><footer>f"
    )
    assert text(page) == "A < b c\n\nOne two x y\n\na\n\nb\n\nLast"


def test_without_article():
    assert text("<body><header>h</header><main><p>m</main><p>out") == "m"
    assert text("plain &amp; simple") == "plain & simple"
    assert text("<div><p>a</p>b<div>c</div></div>") == "a\n\nb\n\nc"
    assert text("") == "" and text("<article></article><p>x") == ""


def test_broken_markup():
    assert text("<article><p><b>a<br><p>b</p></article>") == "a\n\nb"
    assert text("<article><p>a &am") == "a &am"
    assert text('<article><p title="a>b">x</p><p class="y>z') .startswith("x")
    assert text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert text("<p>a < b and c</p>") == "a < b and c"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, text int")


def test_templates_go_and_copies_stay(spark):
    box = "<div><p>Read more on our site</p></div>"
    rows = [
        (i, "http://H.org/x?y", f"<body>{box}<div><p>Story {i} is here</p></div></body>") for i in range(20)
    ]
    # Copies of one page count once, so its own text is no template.
    rows += [(100 + i, "http://c.org/", "<body><div><p>The same story</p></div></body>") for i in range(50)]
    rows += [(200, None, None), (None, "no url", ""), (201, "http://solo.org", f"<body>{box}<p>x")]
    got = {}
    for r in html_extract.main_text(pages_of(spark, rows)).collect():
        got.setdefault(r["page_id"], []).append((r["text"], r["n_chars"]))
    assert all(got[i] == [(f"Story {i} is here", len(f"Story {i} is here"))] for i in range(20))
    assert all(got[100 + i] == [("The same story", 14)] for i in range(50))
    assert got[200] == [("", 0)] and got[None] == [("", 0)]
    assert got[201][0][0] == "Read more on our site\n\nx"
    assert html_extract.main_text(pages_of(spark, [])).count() == 0


def test_templates_of_few_pages_of_a_large_host(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    box = "<div><p>Tickets of the spring section are on sale</p></div>"
    stories = [words(40) for _ in range(2000)]
    rows = [(i, "http://big.org/", f"<body>{box if i % 50 == 0 else ''}<p>{s}</p></body>") for i, s in enumerate(stories)]
    # Near copies of one article: its parts recur beside a line of their own.
    parts = [words(60) for _ in range(3)]
    article = "".join(f"<div><p>{p}</p></div>" for p in parts)
    rows += [(5000 + i, "http://big.org/", f"<body>{article}<p>Copy {i}</p></body>") for i in range(60)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages_of(spark, rows)).collect()}
    assert all(got[i] == s for i, s in enumerate(stories))
    assert all(got[5000 + i] == "\n\n".join([*parts, f"Copy {i}"]) for i in range(60))


def test_references_cut_by_tags():
    assert text("<p>a&am<b>p;</b>lt; &lt;b&gt; &#233;&eacute;</p>") == "a&amp;lt; <b> éé"


def test_class_names():
    keep = ["social-history", "menu-of-the-day", "notice-of-war", "related", "menu", "promotion", "addition", "shared"]
    page = "<article>" + "".join(f"<div class='x {name}'>{name}</div>" for name in keep)
    page += "<div class=share-buttons>s</div><div class='comment-list'>c</div><p class='ads box'>a</p></article>"
    assert text(page) == "\n\n".join(keep)
    outside = "".join(f"<div class={n}>{n}</div>" for n in ("site-footer", "cookie-notice", "menu", "related-posts", "social-history"))
    assert text(f"<body>{outside}</body>") == "social-history"


def seconds(source):
    start = time.perf_counter()
    page = html_extract.parse(source)
    page.text({1, 2, 3})
    return time.perf_counter() - start


def test_long_pages_take_time_in_proportion():
    for part in ("<div>x", "<a ", "<a '", '<a ">', "<!-- ", "<p>&am", "<li>", "<b><i>", "</p>", "< ", "<table><tr><td>"):
        assert seconds(part * ((1 << 20) // len(part))) < 5, part


def test_six_near_copies_among_twenty_pages(spark):
    """Parts of copied articles are in a tenth of the pages, and stay; a box on unlike pages goes."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    box = "<div><ul><li>Follow us<li>on the web</ul></div>"
    parts = [words(40) for _ in range(4)]
    copied = "".join(f"<div>{p}</div>" for p in parts)
    stories = [words(80) for _ in range(14)]
    rows = [(i, "http://h.org/", f"<body>{copied}<p>Copy {i}</p></body>") for i in range(6)]
    rows += [(10 + i, "http://h.org/", f"<body>{box}<p>{s}</p></body>") for i, s in enumerate(stories)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages_of(spark, rows)).collect()}
    assert all(got[i] == "\n\n".join([*parts, f"Copy {i}"]) for i in range(6))
    assert all(got[10 + i] == s for i, s in enumerate(stories))


def test_lists_and_tables_of_articles_are_counted(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    box = "<ul><li>See also<li>All news</ul><table><tr><td>Rates</table><figure>Logo</figure>"
    rows = [(i, "http://h.org/", f"<article><p>{words(60)}</p>{box}<p>Yes.</p></article>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages_of(spark, rows)).collect()}
    assert all("See also" not in t and "Rates" not in t and "Logo" not in t and t.endswith("Yes.") for t in got.values())


def test_bands_tell_near_copies():
    rng = random.Random(1)
    base = [f"w{rng.randrange(9000)}" for _ in range(400)]
    changed = lambda n: [f"x{rng.randrange(10**9)}" if i in set(rng.sample(range(400), n)) else w for i, w in enumerate(base)]
    near = [" ".join(base), *(" ".join(base[:200] + [f"y{k}"] * 3 + base[200:]) for k in range(40))]
    far = [" ".join(f"w{rng.randrange(9000)}" for _ in range(400)) for _ in range(40)]
    table = html_extract.bands(near + far + ["", "a b", "a b"])
    assert all(set(table[0]) & set(table[i]) for i in range(1, 41))
    assert not any(set(table[0]) & set(table[i]) for i in range(41, 83))
    assert set(table[-1]) == set(table[-2])


def by_hand(pages):
    """Main texts by plain patterns, for pages with one flat article, and no template inside it."""
    out = {}
    for page_id, source in pages:
        found = re.search(r"<article>(.*?)</article>", source or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", found[1]) if found else []
        plain = [" ".join(html.unescape(re.sub(r"<br>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in blocks]
        out[page_id] = "\n\n".join(b for b in plain if b)
    return out


def test_whole_table_by_plain_patterns(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages).collect()}
    assert got == by_hand([(r["page_id"], r["html"]) for r in pages.collect()]) and len(got) == 250


def templates_by_hand(pages):
    """Templates of every host by exact five-word Jaccard over all pairs of its pages."""
    hosts, out = {}, {}
    for page_id, host, source in pages:
        hosts.setdefault(host, []).append((page_id, html_extract.parse(source or "")))
    for own in hosts.values():
        sets = []
        for _, page in own:
            words = page.text().lower().split()
            sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))})
        group = list(range(len(own)))
        for a in range(len(own)):
            for b in range(a):
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
                    group = [group[b] if g == group[a] else g for g in group]
        unlike = {}
        for at, (_, page) in enumerate(own):
            for digest in set(page.hashes):
                unlike.setdefault(digest, set()).add(group[at])
        least = max(5, 0.1 * len(set(group)))
        gone = {d for d, g in unlike.items() if len(g) >= min(least, 20)}
        out |= {page_id: page.text(gone) for page_id, page in own}
    return out


def test_templates_equal_brute_force(spark):
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    rows = []
    for host in range(5):
        boxes = [f"<div><p>{words(4)}</p><div>{words(3)}</div></div>" for _ in range(6)]
        copied = [f"<div>{words(50)}</div>" for _ in range(3)]
        for i in range(rng.choice([12, 40, 70])):
            body = "".join(b for k, b in enumerate(boxes) if rng.random() < 0.04 * 2**k / 4)
            body += "".join(copied) if i % 4 == 0 else f"<section>{words(60)}</section>"
            rows.append((len(rows), f"http://h{host}.org/", f"<body>{body}<p>{words(2)}</p></body>"))
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages_of(spark, rows)).collect()}
    assert got == templates_by_hand(rows)


def test_paragraphs_of_articles_are_no_templates(spark):
    rows = [(i, "http://h.org/", f"<article><p>Yes.</p><p>No {i}</p></article>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages_of(spark, rows)).collect()}
    assert got[3] == "Yes.\n\nNo 3"
