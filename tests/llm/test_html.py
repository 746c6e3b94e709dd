"""Main text of pages: planted boilerplate goes, article text stays whole, both ways of handing out trees agree."""

import html as H
import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidegate.llm import html

PAGES = "page_id long, url string, html string"


def site(n, host, rng):
    """Pages with a notice that no name announces, repeated on all of a host."""
    rows = []
    for i in range(n):
        parts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(rng.randrange(3, 30))) for _ in range(rng.randrange(1, 5))]
        body = "".join(f"<p>{H.escape(p)} &amp; é" for p in parts)
        page = f"<html><head><title>t{i}</title><style>p{{}}</style></head><body><nav><a href=x>menu {i}</a></nav><div class='x1'><p>We value all our readers.</p></div><div class='x2'><h1>Title {i}</h1>{body}</div><aside>more</aside><div id=comments><p>nice {i}</p></div><script>var a='<p>no</p>'</script><footer>&copy; {host}</footer></body></html>"
        rows.append((i, f"https://{host}/a/{i}", page, "\n".join([f"Title {i}", *(f"{p} & é" for p in parts)])))
    return rows


def test_repeated_branches_go_and_articles_stay(spark):
    rng = random.Random(2)
    rows = site(60, "one.example", rng)
    copies = [(100 + k, f"https://one.example/copy/{k}", rows[0][2], rows[0][3]) for k in range(300)]
    frame = spark.createDataFrame([r[:3] for r in rows + copies], PAGES).withColumns({"host": F.lit("clash"), "tree": F.lit(1), "salt": F.lit(2)})
    found = html.extract(frame).collect()
    wanted = {r[0]: r[3] for r in rows + copies}
    assert {r.page_id: r.text for r in found} == wanted and all(r.n_chars == len(r.text) for r in found)
    assert sorted(map(tuple, html.extract(frame, sent_entries=-1).collect())) == sorted(map(tuple, found))


def test_edge_cases(spark):
    rows = [
        (1, "http://a/x", None), (2, None, ""), (3, "::bad[", "plain text only"), (4, "http://a/", "<article>one<br>two &lt;b&gt; &#233;&nbsp;x</article>"),
        (5, "http://a/", "<p>a<p>b<div>c</div>d<!-- <p>no --> e"), (6, "http://a/", "<article><header><h1>T</h1></header><p>x</p><div class='comments'>y</div></article><p>out"),
        (7, "http://a/", "<div><div class='side-bar'><p>s</div><main><p>  m\n\t n  </p></main>"), (8, "http://a/", "<div" * 50), (9, "http://a/", "<b>" * 3000 + "deep"), (9, "http://a/", "<p>again"),
    ]
    found = [(r.page_id, r.text) for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()]
    by_id = dict(found)
    assert len(found) == len(rows) and by_id[1] == by_id[2] == "" and by_id[3] == "plain text only" and by_id[4] == "one two <b> é x"
    assert by_id[5] == "a\nb\nc\nd e" and by_id[6] == "T\nx" and by_id[7] == "m n"
    assert (9, "deep") in found and (9, "again") in found
    assert html.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_paths_stay_whole_at_any_depth(spark):
    """Below many named wrappers, a repeated branch goes and an article keeps its header and named parts."""
    above = "".join(f"<div class='outer wrapper level column' id='container block grid cell{i}'>" for i in range(40))
    rows, wanted = [], {}
    for i in range(40):
        own = " ".join(f"w{i}x{k}" for k in range(12))
        rows.append((i, f"https://deep.example/{i}", f"<html><body>{above}<div class='x1'><p>We value all our readers.</p></div><article><header><h1>Title {i}</h1></header><div class='banner'><p>{own}</p></div></article>"))
        wanted[i] = f"Title {i}\n{own}"
    assert {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()} == wanted
    node, labels = html.parse(rows[0][2]), []
    while node:
        labels.append(node.path)
        node = next((x for x in node.children if isinstance(x, html.Node)), None)
    assert len(labels) > 40 and len(set(labels)) == len(labels) and max(map(len, labels)) < 120


def test_the_tree_decides(spark):
    """Without its host's tree a page keeps everything; evidence counts by what it holds on the whole host."""
    rng = random.Random(5)
    rows = site(30, "decided.example", rng)
    pages = spark.createDataFrame([r[:3] for r in rows], PAGES)
    tree = html.as_tree(html.site_style_tree(pages).filter("host = 'decided.example'").collect())
    assert all(html.main_text(r[2], tree) == r[3] != html.main_text(r[2], html.NO_TREE) for r in rows)
    real = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    with_tree = {r.page_id: r.text for r in html.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    changed = sum(html.main_text(r.html, html.NO_TREE) != with_tree[r.page_id] for r in real.collect())
    assert changed == len(with_tree) == 250

    def words(n):
        return " ".join(f"w{rng.randrange(9999)}" for _ in range(n))

    # A wrapper that is called a sidebar but holds the text stays, its menu and a strong name go; teasers in articles decide nothing.
    held = []
    for i in range(20):
        own, teaser = words(60), words(5)
        held.append((i, f"https://side.example/{i}", f"<div class='sidebar'><nav><p>{words(40)}</nav><p>{own}<div class=comments><p>{words(90)}</div></div>", own))
        held.append((100 + i, f"https://tease.example/{i}", f"<div class='text'><p>{own}</div><article><p>{teaser}</article><div class='sidebar'><p>{words(9)}</div>", f"{own}\n{teaser}"))
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame([r[:3] for r in held], PAGES)).collect()}
    assert found == {r[0]: r[3] for r in held}


def test_very_long_pages(spark):
    body = "".join(f"<p>paragraph {k} of the page" for k in range(40000))
    rows = [(1, "http://long.example/", f"<nav>menu</nav><article>{body}</article>"), (2, "http://long.example/2", "<article>" + "<div>" * 20000 + "deep" + "</div>" * 20000), (3, None, "<p>no host")]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert found[1].count("\n") == 39999 and found[2] == "deep" and found[3] == "no host"


def test_names_announce_by_all_their_words(spark):
    body = "".join(f"<div class='{c}'><p>{c} stays here</p></div>" for c in ("share-price", "comment-worthy side-effects", "menu-engineering", "adverb"))
    gone = "".join(f"<div class='{c}'><p>{c} goes</p></div>" for c in ("share-buttons", "comment-list", "ad-slot-3", "site-nav cookie_banner"))
    page = f"<body><article><h1>Prices</h1>{body}{gone}</article>{gone}</body>"
    (row,) = html.extract(spark.createDataFrame([(1, "http://names.example/", page)], PAGES)).collect()
    assert row.text == "Prices\nshare-price stays here\ncomment-worthy side-effects stays here\nmenu-engineering stays here\nadverb stays here"


def tree_by_brute_force(pages):
    """(host, path) -> (removed, common) of the site style trees, counted page by page."""
    hosts = defaultdict(set)
    for url, page in pages:
        if page:
            hosts[html.host(url)].add(page)
    out = {}
    for host, own in hosts.items():
        style, content, mass = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
        for page in own:
            root = html.parse(page)
            for path, kinds in html._style(root).items():
                style[html.digest(path)][kinds] += 1
            found = html.blocks(root, lambda node: False)
            for path, text in {(html.digest(owner[-1].path if owner else ""), text) for owner, text in found}:
                content[path][text] += 1
            inside = beside = 0
            for owner, text in found:
                mass[0]["page"] += len(text)
                for path, weak in {(n.path, n.weak) for n in owner if n.dull}:
                    mass[html.digest(path)]["weak" if weak else "strong"] += sum(len(text) for n in owner if n.dull and n.path == path)
                if any(n.inside for n in owner):
                    inside += len(text) * (not any(n.dull and not n.weak for n in owner))
                else:
                    beside += len(text) * (not any(n.dull for n in owner))
            if inside:
                mass[0]["inside"] += inside
                mass[0]["beside"] += beside

        def entropy(counts, n_pages):
            total = sum(counts.values()) + html.PRIOR_PAGES
            return min(1.0, (math.log(total) - sum(n * math.log(n) for n in counts.values()) / total) / math.log(n_pages + html.PRIOR_PAGES))

        for path, counts in content.items():
            n_pages = sum(style[path].values())
            if not n_pages:
                continue
            composite = (1 - html.DAMPING) * entropy(style[path], n_pages) + html.DAMPING * entropy(counts, n_pages)
            common = frozenset(html.digest(t) for t, n in counts.items() if n >= (n_pages + html.PRIOR_PAGES) * html.COMMON_SHARE)
            if composite < html.LEAST_IMPORTANCE or common:
                out[host, path] = (True if composite < html.LEAST_IMPORTANCE else None, common)
        for path, held in mass.items():
            if path:
                removed = not (not held["strong"] and held["weak"] >= html.LEAST_SHARE * mass[0]["page"])
                before, common = out.get((host, path), (None, frozenset()))
                out[host, path] = (removed or before is True, common)
        if mass[0]["inside"] and mass[0]["inside"] >= html.LEAST_SHARE * (mass[0]["inside"] + mass[0]["beside"]):
            out[host, 0] = (True, out.get((host, 0), (None, frozenset()))[1])
    return out


def test_trees_against_brute_force(spark):
    """Every decision of every host's tree, on all pages of the table and on sites with repeated notices and copies."""
    rng = random.Random(11)
    made = [r[:3] for k in range(4) for r in site(rng.randrange(3, 40), f"h{k}.example", rng)]
    made += [(900 + k, "https://h0.example/copy", made[0][2]) for k in range(20)]
    made += [(950 + k, f"https://same.example/{k}", f"<body><div class='top'><p>one notice</p></div><div class='sidebar'><p>{k} " + "text " * (k + 3) + "</p></div>") for k in range(12)]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame(made, PAGES))
    found = {(r.host, r.path): (r.removed, frozenset(r.common)) for r in html.site_style_tree(pages).collect()}
    wanted = tree_by_brute_force([(r.url, r.html) for r in pages.collect()])
    assert found == wanted and any(c for _, c in wanted.values()) and len(wanted) > 100
