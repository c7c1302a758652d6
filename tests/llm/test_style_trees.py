"""The main text by style trees: judged nodes and final texts against brute force, names inside articles, hosts of any size."""

import math
import random
from collections import Counter, defaultdict

from strandloom.llm import html_text


def brute_trees(pages, gamma=0.9):
    """node -> (pages, share of pages that call it furniture, whether it has texts, importance) of merged (host, html) pages."""
    texts, styles, holders, low, parent = defaultdict(Counter), defaultdict(Counter), Counter(), Counter(), {}
    for host, page in pages:
        p = html_text.parse(page or "")
        for k, t in {(k, html_text.likeness(t, host)) for k, t in p.blocks if k}:
            texts[k][t] += 1
        for k, found in p.styles.items():
            styles[k].update(found)
        for k, (up, _, own) in p.nodes.items():
            holders[k] += 1
            low[k] += own
            parent[k] = up
    children = defaultdict(list)
    for k, up in parent.items():
        children[up].append(k)

    def importance(k):
        m = holders[k]
        inner = [importance(c) for c in children[k]]
        below = bool(inner)
        content = None
        if texts[k]:
            content = 1.0 if m == 1 else 1 - sum(math.log(n, m) for n in texts[k].values()) / len(texts[k])
            inner.append(content)
        if not below:
            return content or 0.0
        total = sum(styles[k].values())
        look = min(1.0, 1.0 if m == 1 else -sum(n / total * math.log(n / total, m) for n in styles[k].values()))
        g = gamma ** len(styles[k])
        return (1 - g) * look + g * sum(inner) / len(inner)

    return {k: (holders[k], low[k] / holders[k], bool(texts[k]), importance(k)) for k in parent}


def brute_texts(pages, least=0.75):
    """The text of each (host, html) page by the trees of all its nodes, node by node."""
    every = brute_trees(pages)
    hosts = {h: brute_trees([p for p in pages if p[0] == h]) for h, _ in pages if h}

    def vote(importance, n, ground, weight):
        votes = min(n - 1, 30)
        return (votes * importance + weight * ground) / (votes + weight)

    out = []
    for host, page in pages:
        dropped, held = set(), set()
        for k, (n, low, texts, importance) in every.items():
            if n < 2 or not texts:
                continue
            score = vote(importance, n, 1 - low, 2)
            if host:
                if k not in hosts[host] or not hosts[host][k][2]:
                    continue
                own = hosts[host][k]
                score = min(score, vote(own[3], own[0], score, 5))
            (held if score >= least else dropped).add(k)
        out.append(html_text.main_text(page or "", dropped, held))
    return out


def random_page(rng, i, host):
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta rho mu nu xi").title() for _ in range(n))
    menu = f"<div class='m{rng.randrange(2)}'>{'Home News' if rng.random() < 0.8 else say(2)}</div>"
    notice = rng.choice(["", "<div class='cookie-note'>We use cookies</div>", f"<p class='z'>{host} in {2000 + i}</p>"])
    body = "".join(f"<p>{say(9)} {i}.</p>" for _ in range(rng.randint(0, 4)))
    kind = rng.choice(["<article>{}</article>", "<div class='a'>{}</div>", "<div class='b'><div class='c'>{}</div></div>"])
    return f"<body>{menu}{kind.format(body)}{notice}<div class='e'>{rng.choice(['Ende', 'Fin', say(3)])}</div></body>"


def test_final_texts_against_brute_force(spark):
    rng = random.Random(21)
    pages = []
    for i in range(150):
        host = rng.choice(["big.example"] * 5 + ["one.example", "two.example", "", f"h{i}.example"])
        pages.append((host, random_page(rng, i, host)))
    pages += [pages[0]] * 40 + [("big.example", None), ("", ""), (f"lone.example", "<p>alone</p>")]
    rows = [(i, f"http://{h}/{i}" if h else None, page, "clash") for i, (h, page) in enumerate(pages)]
    frame, want = spark.createDataFrame(rows, "page_id long, url string, html string, text string"), dict(enumerate(brute_texts(pages)))
    for most in (4 << 20, 0):  # sent to all tasks, and joined
        got = {r.page_id: r.text for r in html_text.extract_main_text(frame, most=most).collect()}
        assert got == want
    plain = [html_text.main_text(page or "", frozenset(), frozenset()) for _, page in pages]
    assert sum(a != b for a, b in zip(plain, got.values())) > 50  # the trees decide


def test_hot_hosts_and_skeletons_are_dealt_out_with_the_same_result(spark, monkeypatch):
    rng = random.Random(22)
    pages = [("big.example", random_page(rng, i, "big.example")) for i in range(60)]
    rows = [(i, f"http://{h}/", page) for i, (h, page) in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = html_text.join_counted
    monkeypatch.setattr(html_text, "join_counted", lambda *a: plain(*a, hot_rows=3))
    assert {r.page_id: r.text for r in html_text.extract_main_text(frame, most=0).collect()} == dict(enumerate(brute_texts(pages)))


def test_adverts_and_sharing_inside_an_article_go_on_a_lone_page(spark):
    page = """<article><h1>Title</h1><p>First words of it.</p><div class="advert">Buy now</div><div class="newsletter">Sign up</div>
    <p class="related">More on it.</p><div class="share">Share this</div><div class="share-prices">Prices rose.</div></article>
    <div class="side">Aside</div><div class="c-consent-layer__text">We use cookies</div>"""
    other = """<p>Plain.</p><div class="side">Aside</div><div class="c-consent-layer__text">We use cookies</div>"""
    rows = [(1, "http://a.example/", page), (2, "http://b.example/", other)]
    got = {r.page_id: r.text for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Title\n\nFirst words of it.\n\nMore on it.\n\nPrices rose.", 2: "Plain."}
