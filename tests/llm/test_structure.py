"""Page text, divergence of sources and repair of conversations on small tables, against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import conversation_repair, divergence, html_extraction

# --- pages ---------------------------------------------------------------------------------------------

RICH = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=/>x</a></ul></nav><div class="cookie-notice">We use cookies</div><div id="wrapper"><div class="content post-12"><header><h1>Title &amp; more</h1><p>by me</p></header>
<p>First <b>bold</b>&nbsp;text<br>line<p>Second &lt;p&gt; <a href="x">link</a> here.<ul><li>one<li>two</ul><div class="ad-slot">Buy</div><blockquote>quote</blockquote><!-- a > b -->
<form><input name=a><label>Name</label><button>Go</button></form><table><tr><td>c1<td>c2</table><script>x<y</script></p></div><div class="sidebar">side text, long long long long</div>
<section id="comments"><h3>Comments</h3><p>reader says</p></section></div><footer>foot</footer></body></html>"""
RICH_TEXT = ["Title & more", "First bold text line", "Second <p> link here.", "one", "two", "quote", "c1", "c2"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (RICH, "\n\n".join(RICH_TEXT)), ("", ""), ("plain &eacute; text", "plain é text"), ("<p", ""), ("a < b", "a < b"), ("<!-- x", ""), ("<div><p>x", "x"), ("</br><main><p>first</p></br><p>second</p></main>", "first\n\nsecond"),
        ("<article><header><h1>A</h1>by</header><p>t</article>", "A\n\nt"), ("<form><p>only</p></form>", "only"), ('<a href="a>b">q</a> r', "q r"), ("<p>a<!-->b</p>", "ab"), ("<script>x", ""), ("<ul><li><a>m</a><li><a>n</a></ul><p>t</p>", "t"), ("<p>&#x1F600;&amp;amp;</p>", "😀&amp;"),
        ("<div class='topnav'>n</div><p>t</p><div class='adBox'>x</div><div class='adslot'>y</div><p class='cookiebar'>z", "t"), ("<P CLASS='no-sidebar'>a<DIV class=commentary>b", "a\n\nb"), ("<div hidden>x</div><p style='Display: None'>y<p role=alert>z<p>t", "t"),
    ],
)
def test_text_of_a_page(html, text):
    assert html_extraction.Page(html).chosen([])[0] == text


@pytest.mark.parametrize("html", ["<div>" * 30_000, '<a href="' * 50_000, "<!--" * 50_000, "<ul><li>" * 20_000, "=" * 500_000, "<b =" + "= '" * 100_000, "<" * 200_000, '<div class="a' + " b" * 100_000])
def test_odd_markup_takes_linear_time(html):
    import time

    began = time.time()
    html_extraction.Page(html).chosen([])
    assert time.time() - began < 5


def page(article: int, side: int) -> str:
    return f"<body><div class='x'><p>{'main ' * article}</p></div><div class='y'><p>{'side ' * side}</p></div></body>"


def test_a_hosts_pages_agree(spark, monkeypatch):
    """A page whose other column is longer is read as its host's other pages are; one alone on its host goes by its own scores."""
    rows = [(i, f"http://H.example/{i}", page(30, 5)) for i in range(9)] + [(9, "http://h.EXAMPLE/9", page(5, 30)), (10, "http://alone/1", page(5, 30)), (11, None, None), (11, None, None), (12, "no host", "<p>t"), (None, "http://h.example?x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("other", F.lit(1))
    got = html_extraction.main_texts(pages)
    assert got.columns == ["page_id", "url", "other", "text", "consensus"]
    want = {(i, "main " * 30, True) for i in range(9)} | {(9, "main " * 5, True), (10, "side " * 30, False), (11, "", False), (12, "t", False), (None, "", False)}
    assert Counter((r.page_id, r.text, r.consensus) for r in got.collect()) == Counter((i, t.strip(), c) for i, t, c in want) + Counter([(11, "", False)])
    monkeypatch.setattr(html_extraction, "BROADCAST", 0)
    assert Counter(map(tuple, html_extraction.main_texts(pages).collect())) == Counter(map(tuple, got.collect()))
    assert html_extraction.main_texts(pages.limit(0)).count() == 0
    assert [(r.path, r.votes) for r in html_extraction.host_paths(pages).collect()] == [("body>div.x", 9)]


def test_a_body_that_wins_is_not_every_pages(spark):
    """Pages of a host that are one column vote for the body; a page with a content column keeps to that."""
    rows = [(i, f"http://h/{i}", "<body><p>plain text</p></body>") for i in range(5)] + [(5, "http://h/5", "<div class=content><p>long content text</p></div><div class=x><p>aside</p></div>")]
    got = {r.page_id: (r.text, r.consensus) for r in html_extraction.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == ("plain text", True) and got[5] == ("long content text", False)


def test_given_pages(spark):
    """The article of the given pages, by plain patterns."""
    from html import unescape

    from siltstone.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op11_html_extraction"](spark, sf).collect()
    assert len(got) == len(html)
    for r in got:
        inner = re.search(r"(?s)<article>(.*?)</article>", html[r.page_id])[1]
        blocks = (" ".join(unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# --- divergences ---------------------------------------------------------------------------------------


def brute_divergences(rows):
    docs = [(t or "", g or "", s or "") for t, g, s in rows]
    words = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), g, s) for t, g, s in docs]
    out = set()
    for lang in {g for _, g, _ in docs}:
        seen = Counter(w for ws, g, _ in words if g == lang for w in set(ws))
        kept = sorted(w for w, n in seen.items() if n >= 30)
        counts = {s: Counter() for _, g, s in docs if g == lang}
        for ws, g, s in words:
            if g == lang:
                counts[s].update(w for w in ws if w in set(kept))
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in counts if o != s)
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((q[w] - p[s][w], w.encode(), w) for w in kept if counts[s][w] > 0 and p[s][w] > q[w])[:50]
            out |= {(lang, s, "term", w, -v, i) for i, (v, _, w) in enumerate(terms, 1)}
    return out


def texts(seed=7):
    rnd = random.Random(seed)
    pool = [w for w in ("Ab", "ab", "é", "ß", "日本", "zz", "a", "x", "\U0001f600", "Éa") for _ in range(3)] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = [(" ".join(rnd.choices(pool, k=rnd.randrange(60))) + rnd.choice(["", "\x00", "1", "_é"]), rnd.choice(["en", "en", "fr", None]), rnd.choice(["a", "b", "c", "é", None])) for _ in range(600)]
    return rows + [(None, "en", "only null"), ("", "de", "a"), ("few words", "de", "b"), ("few words", "de", "b"), (None, None, None), ("w1", "", "")]


def test_divergences_against_brute_force(spark, monkeypatch):
    rows = texts()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, value int")
    want = brute_divergences(rows)
    assert {tuple(r) for r in divergence.divergences(docs).collect()} == want
    monkeypatch.setattr(divergence, "BLOCK", 1)  # many blocks of terms
    monkeypatch.setattr(divergence, "LARGE", 40)
    got = divergence.divergences(docs.repartition(3)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert divergence.divergences(docs.limit(0)).count() == 0


def test_terms_at_edges_and_in_pieces(spark, monkeypatch):
    data = "abÉ9c|ab".encode()
    starts, ends = divergence.term_slices(np.frombuffer(data, np.uint8), np.array([0, 2, 2, len(data)]))
    assert [data[a:b].decode() for a, b in zip(starts, ends)] == ["ab", "É", "c", "ab"]
    codes, found = divergence.grouped_slices(np.frombuffer(data, np.uint8), starts, ends, hashed=lambda b: len(b) % 2)  # all hashes collide
    assert [found[i] for i in codes] == [data[a:b] for a, b in zip(starts, ends)]
    monkeypatch.setattr(divergence, "SLICE", 50)
    text = " ".join(["word", "é" * 200, "Z"] * 40)
    from pyarrow import array, record_batch

    total = Counter()
    for b in divergence._counted([record_batch({"text": array([text]), "lang": array(["x"]), "source": array(["y"])})]):
        total.update({t: n for t, n in zip(b.column("term").to_pylist(), b.column("n").to_pylist())})
        assert set(b.column("docs").to_pylist()) <= {0, 1}
    assert total == {b"": 0, b"word": 40, "é".encode() * 200: 40, b"z": 40}


def test_shares_are_exact():
    rnd = random.Random(3)
    for most in (10**3, 10**9, 9 * 10**15, 4 * 10**18):
        total = [rnd.randrange(1, most) for _ in range(200)]
        n = [rnd.randrange(1, t + 1) for t in total]
        assert divergence.share(np.array(n), np.array(total)).tolist() == [1 + 10**9 * a // b for a, b in zip(n, total)]


# --- conversations ---------------------------------------------------------------------------------------


def brute_damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [] if code == 0 else [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def brute_repair(rows):
    """All of a conversation's edits, by walking every sequence within the least cost found by deepening."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        filled = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not filled else "duplicate" if (role, text) in seen else "truncated" if filled[-1] not in ".!?" else "")
        seen.add((role, text))
    best = []

    def walk(i, cost, most, audit, lines, initials):
        if cost > most or not re.fullmatch("(s?(u|ua(ua)*u?)?)?", initials):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best.append((cost, audit, "\n".join(lines)))
        if cost + 3 <= most:
            for role in ("user", "assistant"):
                walk(i, cost + 3, most, audit + "I", [*lines, f"{role}:"], initials + role[0])
        if i < len(rows):
            role, text, extra = rows[i][2], rows[i][3], 3 * (faults[i] == "truncated")
            walk(i + 1, cost + 4, most, audit + "D", lines, initials)
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] and role[0] in "sua":
                    walk(i + 1, cost + extra, most, audit + "K", [*lines, f"{role}:{text}"], initials + role[0])
                for new in ("user", "assistant"):
                    walk(i + 1, cost + 3 + extra, most, audit + "R", [*lines, f"{new}:{text}"], initials + new[0])

    most = 0
    while not best:
        walk(0, 0, most, "", [], "")
        most += 1
    cost, audit, text = min(best)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def conversations(n=60, seed=5):
    rnd = random.Random(seed)
    roles, said = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"], ["Yes.", "No!", "why ?  ", "cut off", " \t\x0b", "", None, "é.", "Yes."]
    rows = [(c, rnd.choice([*range(8), None]) if rnd.random() < 0.4 else t, rnd.choice(roles), rnd.choice(said)) for c in range(n) for t in range(rnd.randrange(1, 6))]
    return rows + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (500, None, "user", "Hi."), (500, None, None, None)]


def test_repair_against_brute_force(spark):
    rows = conversations()
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int")
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_audit(table.repartition(3)).collect()}
    hurt = brute_damaged(rows)
    want = {c: brute_repair([r for r in hurt if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want
    assert any(all(r[0] != c for r in hurt) for c in want)  # one has lost all its rows
    assert conversation_repair.repair_audit(table.limit(0)).count() == 0


def test_edits_are_rows_in_order(spark):
    rows = [("x", 0, "user", "A?"), ("x", 1, "user", "B."), ("x", 2, "assistant", "C."), ("x", 3, "assistant", "C.")]
    got = conversation_repair.repaired(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()
    assert [(r.place, r.turn, r.was, r.fault, r.edit, r.role, r.text, r.cost) for r in got] == [
        (0, 0, "user", "", "K", "user", "A?", 0), (1, None, None, None, "I", "assistant", "", 3), (2, 1, "user", "", "K", "user", "B.", 0), (3, 2, "assistant", "", "K", "assistant", "C.", 0), (4, 3, "assistant", "duplicate", "D", "assistant", "C.", 4)
    ]


def test_a_long_conversation_is_settled_as_it_goes():
    rnd = random.Random(2)
    repair, short, letters, most = conversation_repair.Repair(), conversation_repair.Repair(), [], 0
    short.limit = 10**9  # never settles before the end
    for i in range(3000):
        row = (i, rnd.choice(["user", "assistant"]) if i % 5 else "user", "x.", rnd.choice(["", "", "", "blank", "truncated"]))
        repair.push(row)
        short.push(row)
        letters += [e[3] for e in repair.settled()]
        most = max(most, len(repair.rows))
    letters += [e[3] for e in repair.ended()]
    assert letters == [e[3] for e in short.ended()] and most < 500
