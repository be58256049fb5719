"""Extraction, decontamination, personal data and the pipeline."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from mountwait.llm import decontam, pii, styletree


def levenshtein_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(last + (p != c), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_matches_equal_full_edit_distance():
    rng = random.Random(4)
    item = "the quick brown fox jumps over the lazy dog and runs away"
    m = decontam.Matcher([(1, item)])
    k = int(len(item) * decontam.ERROR_RATE)
    hits = 0
    for _ in range(300):
        x = list(item)
        for _ in range(rng.randint(0, k + 3)):
            at = rng.randrange(len(x))
            x[at:at + 1] = rng.choice([[], [rng.choice("abc ")], [x[at], rng.choice("xyz")]])
        text = "some words " + "".join(x) + " more words"
        d = levenshtein_inside(item, text)
        got = m.find(text)
        assert (0 in got) == (d <= k), (text, d, got)
        if got:
            assert got[0] == d
        hits += bool(got)
    assert 50 < hits < 300


def test_items_that_share_text_equal_full_edit_distance():
    """Shared heads, tails and whole items, of many lengths: every item as if it were alone."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    head, tail = say(9), say(7)
    items = [head + " " + say(rng.randint(0, 12)) for _ in range(6)] + [say(rng.randint(1, 9)) + " " + tail for _ in range(4)]
    items += [head, tail, items[0], "abc", head[:40]]
    items = [i.strip() for i in items]
    m = decontam.Matcher(list(enumerate(items)))
    for _ in range(40):
        x = list(rng.choice(items))
        for _ in range(rng.randint(0, len(x) // 8)):
            at = rng.randrange(len(x))
            x[at:at + 1] = rng.choice([[], [rng.choice("abc ")], [x[at], rng.choice("xyz")]])
        text = " ".join([say(3), "".join(x), head, say(4), rng.choice([tail, ""])])
        got = m.find(text)
        for n, item in enumerate(items):
            d = levenshtein_inside(item, text)
            assert got.get(n) == (d if d <= min(int(len(item) * decontam.ERROR_RATE), len(item) - 1) else None), (item, text)
        assert bool(m.find(text, first=True)) == bool(got)


def test_cost_of_shared_heads():
    """A text full of the head that all items share: verified once a place, not once an item and piece."""
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    head = say(15)[:88]
    text = " ".join(head + " " + say(1) for _ in range(120))
    took = {}
    for count in (100, 1000):
        m = decontam.Matcher([(i, head + say(10)) for i in range(count)])
        t0 = time.perf_counter()
        assert m.find(text) == {}
        took[count] = time.perf_counter() - t0
    assert took[100] < 3
    m = decontam.Matcher([(i, head + say(10)) for i in range(1000)] + [(-1, head + " and the end")])
    assert {m.keys[n] for n in m.find(text + " " + head + " and the end")} == {-1}


def test_contaminated_documents(llm, docs, odd):
    items = llm.createDataFrame([(1, "What is the\n capital of  France today?"), (2, None), (3, "  "), (4, "tiny")],
                                "item_id long, text string")
    rows = odd + [(50, "Q: what is the capital of France today? A: Paris"), (51, "what is the capitol of france tody?"),
                  (52, "what is a different question altogether?"), (53, "a TINY thing")]
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.contaminated(docs(rows), items).collect()}
    assert got == {(50, 1, 0), (51, 1, 2), (53, 4, 0)}
    kept = decontam.keep_clean(docs(rows), items)
    assert kept.count() == len(rows) - 3 and "score" in kept.columns
    none = llm.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs(rows), none).count() == 0 and decontam.keep_clean(docs(rows), none).count() == len(rows)


def brute_spans(text):
    out = [("email", m.start(), m.end()) for m in
           re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_equal_the_patterns(real):
    rng = random.Random(6)
    texts = [t for _, t in real]
    for _ in range(1500):
        texts.append("".join(rng.choice(["a", "b.c", "@", ".", "1", "25", "256", " ", "-", "+1 (", ")", "555-1234",
                                         "4111 1111 1111 1111", "x@y.zz", "é", "%"]) for _ in range(rng.randint(1, 14))))
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t


def test_spans_keep_the_base_and_add_to_it(docs, odd):
    hexes = [hashlib.sha1(bytes([i])).hexdigest() for i in range(80)]
    rows = odd + [(100 + i, f'word token = "{h}" word a{i}@mail.example.com call +1 (212) 555-{1000 + i} 10.0.0.{i} end')
                  for i, h in enumerate(hexes)] + [(300 + i, f"the number {1000000 + 7 * i} is plain") for i in range(80)]
    rows.append((400, "a lone \"" + "0123456789abcdef" * 2 + "01234567\" here"))
    got = {r.doc_id: r for r in pii.find(docs(rows)).collect() if r.doc_id is not None}
    for i, t in rows:
        if i is None or i == 4:
            continue
        base = brute_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.join_spans(base).encode()).hexdigest()
        assert set(filter(None, pii.join_spans(base).split(","))) <= set(got[i].spans.split(","))
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(
            sum(s[0] == k for s in base) for k in pii.BASE_KINDS)
    assert sum("secret" in got[100 + i].spans for i in range(80)) > 60
    assert all(got[300 + i].spans == "" for i in range(80))
    out = pii.redacted(docs(rows))
    assert out.columns == docs(rows).columns
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[1].text is None and texts[2].text == "" and "@" not in texts[150].text
    assert texts[150].n_chars == len(texts[150].text) and texts[150].score == 150
    assert pii.find(docs([])).count() == 0


def test_other_forms_of_the_fixed_kinds_are_found(docs):
    """Phone numbers without + and written-out addresses, where the patterns find their usual forms."""
    rows = [(i, f"write to user{i}@mail{i % 7}.example.com or call +1 (212) 555-{1000 + i} today") for i in range(150)]
    rows += [(200 + i, f"the number {1000000 + 7 * i} is plain, order {31 * i + 5000000000} too") for i in range(150)]
    rows += [(400 + i, f"write to user{i} [at] mail{i % 7} [dot] example [dot] com or call (212) 555-{3000 + i} today") for i in range(20)]
    got = {r.doc_id: r.text for r in pii.redacted(docs(rows)).collect()}
    assert all(got[i] == "write to [EMAIL] or call [PHONE] today" for i in (*range(150), *range(400, 420)))
    assert all(got[i] == t for i, t in rows if 200 <= i < 400)


def test_rare_kinds_are_not_switched_off(docs):
    """A kind in few of very many documents, and one with too few positives to learn from."""
    rows = [(i, f"the plain number {1000000 + i} in document {i}") for i in range(8000)]
    rows += [(10_000 + i, f'the word token = "{hashlib.sha1(bytes([i])).hexdigest()}" in a text') for i in range(40)]
    few = [(1, f'the word token = "{hashlib.sha1(b"x").hexdigest()}" in a text'), (2, "me [at] mail [dot] com"),
           (3, "or (212) 555-0100 then"), (4, "the plain number 1000000 stays")]
    got = {r.doc_id: r.text for r in pii.redacted(docs(rows)).collect()}
    assert sum(got[10_000 + i] == 'the word token = "[SECRET]" in a text' for i in range(40)) >= 36
    assert all(got[i] == t for i, t in rows[:8000])
    got = {r.doc_id: r.text for r in pii.redacted(docs(few)).collect()}
    assert got == {1: 'the word token = "[SECRET]" in a text', 2: "[EMAIL]", 3: "or [PHONE] then", 4: few[3][1]}


def test_recall_and_precision_on_planted_forms(docs, real):
    """Forms that the fixed patterns do not hold, in texts of many kinds; look-alikes stay."""
    rng = random.Random(3)

    def code(n, chars="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"):
        return "a1" + "".join(rng.choices(chars, k=n - 2))
    forms = [lambda: f"password = {code(9)}!", lambda: f"api key: {code(12)}-{code(12)}",
             lambda: f"token = {code(20)}.{code(14)}.{code(16)}", lambda: f"the pwd is {code(8)}",
             lambda: f"secret: \"{code(24)}\""]
    planted, rows = [], []
    for i in range(240):
        body = real[i % len(real)][1][:300]
        if i % 3 == 0:
            lead, value = forms[i // 3 % len(forms)]().rsplit(" ", 1)
            value, lead = value.strip('"'), lead + (' "' if value[0] == '"' else " ")
            kind = "secret"
        elif i % 3 == 1:
            names = [rng.choice(["mara", "theo", "ines", "olaf"]), rng.choice(["dot smith", "dot berg", "dot silva"])]
            kind, lead, value = "email", "write to ", f"{' '.join(names)} at {code(6).lower()} dot org"
        else:
            kind, lead, value = "ip", "host ", "2001:db8::" + ":".join(f"{rng.randrange(1, 65536):x}" for _ in range(4))
        planted.append((i, kind, len(body) + 1 + len(lead), len(value)))
        rows.append((i, f"{body} {lead}{value} and more"))
    clean = ["the password is required here", "meet at 12:30:45 or 08:15:00", "std::vector::size of a::b", "key: value and token = none",
             "look at the dot on the map", "a state-of-the-art self-contained well-known re-use of it"]
    rows += [(1000 + i, t) for i, t in enumerate(clean * 5)]
    got = {r.doc_id: set((r.spans or "").split(",")) for r in pii.find(docs(rows)).collect()}
    hits = {k: [f"{k}:{a}:{a + n}" in got[i] for i, kind, a, n in planted if kind == k] for k in ("secret", "email", "ip")}
    assert all(sum(h) >= 0.9 * len(h) for h in hits.values()), {k: sum(h) / len(h) for k, h in hits.items()}
    assert {t: got[1000 + i] for i, t in enumerate(clean) if got[1000 + i] != {""}} == {}
    # What is added beside the planted spans, in the same texts.
    base = {r.doc_id: set(pii.join_spans(pii.base_spans(r.text)).split(",")) for r in docs(rows).collect()}
    added = sum(len(got[i] - base[i] - {""}) for i in range(240))
    assert sum(map(sum, hits.values())) >= 0.9 * added, added


def test_work_on_proposals_is_linear():
    for t in ("a dot ", "a at ", "1:", "ab-1", "a dot b at ", "key=is ", "::"):
        begin = time.perf_counter()
        pii.proposals(t * 100_000)
        assert time.perf_counter() - begin < 10, t


def test_proposals_are_whole():
    """Five groups, long tokens and long local parts are proposed whole; long number runs stay linear."""
    def has(text, kind, s):
        a = text.index(s)
        assert (kind, a, a + len(s)) in pii.proposals(text), s
    has("call 06 12 34 56 78 now", "phone", "06 12 34 56 78")
    has("call 0 6 1 2 3 4 5 6 7 8 now", "phone", "0 6 1 2 3 4 5 6 7 8")
    has("call (0)6" + "." * 50 + "12345678 now", "phone", "(0)6" + "." * 50 + "12345678")
    key = "0123456789abcdef" * 16
    has(f'token = "{key}"', "secret", key)
    has(f"mail {'ab.' * 40}c [at] mail [dot] com", "email", f"{'ab.' * 40}c [at] mail [dot] com")
    assert len(pii.proposals("1 " * 20_000)) <= 13 * 20_000
    text = f'the token = "{key}" is long'
    trees = pii.Trees(*[pii.np.zeros((0, 1), int)] * 3, 0.0, {k: 2.0 for k in pii.KINDS})
    assert pii.redact(text, pii.find_spans(text, trees)[1]) == 'the token = "[SECRET]" is long'


def brute_boost(x, y, w, edges):
    """Margins of the rows of x after boosting on those of weight above 0, and a function for other rows: plain masks."""
    p = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
    margin = np.full(len(x), np.log(p / (1 - p)))
    for _ in range(pii.ROUNDS):
        prob = 1 / (1 + np.exp(-margin))
        g, h = np.rint(pii.UNIT * w * (y - prob)), np.rint(pii.UNIT * w * prob * (1 - prob))
        add = np.zeros(len(x))

        def grow(at, level):
            gs, hs = g[at].sum() / pii.UNIT, h[at].sum() / pii.UNIT
            if level == pii.DEPTH:
                add[at] = pii.RATE * gs / (hs + 1)
                return
            best, side = 1e-6, None
            for j, e in enumerate(edges if (at & (w > 0)).sum() > 8 else []):
                for c in e:
                    low = at & (x[:, j] <= c)
                    gl, hl = g[low].sum() / pii.UNIT, h[low].sum() / pii.UNIT
                    gain = gl ** 2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs ** 2 / (hs + 1)
                    if gain > best:
                        best, side = gain, x[:, j] <= c
            if side is None:
                grow(at, level + 1)
            else:
                grow(at & side, level + 1)
                grow(at & ~side, level + 1)
        grow(np.ones(len(x), bool), 0)
        margin = margin + add
    return margin


def test_trees_and_thresholds_come_from_all_spans(docs):
    """Weights, quantiles, trees and thresholds against plain counts over every span, more than a class may weigh."""
    texts = [f"order {10_000_000 + 7919 * i} or {i % 9}{i}-{1000 + i}-{i % 7}000 and x" for i in range(1500)]
    texts += [f"write to user{i}@mail{i % 7}.example.com or call +1 (212) 555-{1000 + i} today" for i in range(90)]
    texts += [f'the word token = "{hashlib.sha1(bytes([i])).hexdigest()}" here' for i in range(60)]
    texts += [f"see {hashlib.md5(bytes([i])).hexdigest()} there" for i in range(50)] * 3
    held = {}
    for t in texts:
        for around, s, y, own in pii.training_spans(t):
            row = held.setdefault((s[0], y, pii.span_key(around, s)), [
                0, pii.span_key(t, own) % pii.FOLDS, pii.features(around, s), pii.shape(around[s[1]:s[2]]) if s[0] == "phone" else ""])
            row[0] += 1
    known = {r[3] for (_, y, _), r in held.items() if y and r[3]}
    rows = [(*k, *r) for k, r in held.items() if k[1] or r[3] not in known]
    kinds, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    n, fold, x = np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    size = {c: sum((k, v) == c for k, v in zip(kinds, y)) for c in {(k, int(v)) for k, v in zip(kinds, y)}}
    assert max(size.values()) > 1.2 * pii.CLASS
    w = np.array([min(1.0, pii.CLASS / size[k, v]) for k, v in zip(kinds, y)])
    freq = np.ceil(w * (1 << 20)).astype(np.int64)
    edges = []
    for col in x.T:
        order = np.argsort(col, kind="stable")
        ends, place = np.cumsum(freq[order]), np.arange(1, pii.BINS) / pii.BINS * (freq.sum() - 1)
        lo, hi = (col[order][np.searchsorted(ends, np.minimum(f(place), freq.sum() - 1), "right")] for f in (np.floor, np.ceil))
        edges.append(np.unique(np.floor(lo + (hi - lo) * (place - np.floor(place)))))
    trees = pii.fit(docs(list(enumerate(texts))))
    assert np.allclose(trees.margin(x), brute_boost(x, y, w, edges), atol=1e-9)
    z = np.zeros(len(x))
    for k in range(pii.FOLDS):
        z = np.where(fold == k, brute_boost(x, y, np.where(fold == k, 0, w), edges), z)
    for kind in pii.KINDS:
        own = (kinds == kind) & (z >= 0)
        step = np.minimum(np.floor(z * pii.GRID), pii.GRID * pii.TOP - 1)
        good = [c for c in sorted(set(step[own])) if (n * y)[own & (step >= c)].sum() >= pii.PRECISION * n[own & (step >= c)].sum()]
        learnt = ((kinds == kind) & (y == 1)).sum() >= pii.LEAST and (n * y)[own].sum()
        assert trees.thresholds[kind] == pytest.approx(1 / (1 + np.exp(-good[0] / pii.GRID)) if learnt and good else 2.0), kind


def test_one_odd_phone_number_does_not_unlabel_all_dates(llm):
    phone = pii.KINDS.index("phone")
    spans = llm.createDataFrame(
        [(phone, 1, k, "000-0000") for k in range(pii.CLASS + 1)] + [(phone, 1, -1, "0000-00-00"), (phone, 1, -2, "")]
        + [(phone, 0, k, s) for k, s in enumerate(["000-0000", "0000-00-00", "", "00 00"])] + [(0, 0, 9, "")],
        "kind int, y int, key long, shape string")
    left = {(r.kind, r["shape"]) for r in pii.without_known_shapes(spans).where("y = 0").collect()}
    assert left == {(phone, "0000-00-00"), (phone, ""), (phone, "00 00"), (0, "")}
    assert pii.without_known_shapes(spans).where("y = 1").count() == pii.CLASS + 3


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var a="</p>";</script></head>
<body class=home><nav><ul><li><a href="/">Home</a><li>About</ul></nav><div class="x7">Follow us everywhere</div>
<!-- c <p>no</p> --><article><h1>Title {i}</h1><p>Some <b>bo</b>ld &eacute;{i}<br>line<p>Second &lt;par&gt; {i}
<section id="comments"><p>nice!</p></section><div class="share-bar">Share</div></article>
<aside>Side</aside><form><p>f</p><input></form><footer>&copy; site</footer>"""


def test_extraction(llm):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i)) for i in range(30)]
    rows += [(100 + i, f"http://k.example/{i}", f"<body><div class=m><p>Own words {i} {i * i}</div><div class=z>Same on all</div>")
             for i in range(300)]
    rows += [(1000, None, None), (1001, "::", ""), (1002, "http://[bad", "plain  text <b>bold</b> &am <p"), (1003, "x", "<p>a<p hidden>b</p>"),
             (1003, "x", "<p>a<p hidden>b</p>"), (1004, "x", "<div>" * 3000 + "deep")]
    df = llm.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    out = styletree.extract(df).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r for r in out}
    assert got[7].text == "Title 7 Some bold é7 line Second <par> 7" and got[7].n_chars == len(got[7].text)
    assert got[105].text == "Own words 5 25"
    assert got[1000].text == "" and got[1000].n_chars == 0 and got[1001].text == ""
    assert got[1002].text == "plain text bold &am" and got[1003].text == "a" and got[1004].text == "deep"
    assert styletree.extract(df.where("false")).count() == 0


def test_extraction_of_a_host_with_many_copies_of_one_article(llm):
    """600 of 1,000 pages share an article under different chrome; others and copies keep their text."""
    shared = "The same long report of the agency about the harbour and its bridges. " * 4
    page = "<body><div class=top>Edition {i}</div><div class=m><p>{t}</p></div><div class=z>Same on all pages</div>"
    rows = [(i, f"http://copies.example/{i}", page.format(i=i, t=shared if i < 600 else f"Report {i} " + f"word{i} " * 40))
            for i in range(1000)]
    plain = "<html><body><nav>Menu</nav><p>{t}</p><footer>Edition {i}</footer>"
    rows += [(2000 + i, f"http://plain.example/{i}", plain.format(i=i, t=shared if i < 600 else f"Own words {i}"))
             for i in range(1000)]
    got = {r.page_id: r.text for r in styletree.extract(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(shared.strip() in got[i] for i in range(600))
    assert all(f"Report {i} word{i}" in got[i] for i in range(600, 1000))
    assert not any("Same on all" in got[i] for i in range(1000))
    assert all(got[2000 + i] == (shared.strip() if i < 600 else f"Own words {i}") for i in range(1000))


def test_extraction_where_names_speak_against_the_text(llm):
    """Wrappers with boilerplate names, a form around the page and teaser articles do not cost the text."""
    own = ["<p>Own report {i} " + f"with words {k} " * 8 + "{i}</p>" for k in range(3)]
    body = "".join(own)
    pages = {"side.example": "<body><div class='site has-sidebar'><div class='elementor-widget-text-editor'>%s</div></div>"
                             "<div class=sidebar>Latest links</div>",
             "form.example": "<body><form id=aspnetForm><div class=nav>Menu</div><div class=c>%s</div></form>",
             "card.example": "<body><div class=c>%s</div><article><p>Teaser one</p></article><article><p>Teaser two</p></article>",
             "span.example": "<body><span class=widget>%s" % "Own report {i} with many words {i}</span><b class=share>Share</b>"}
    rows = [(1000 * k + i, f"http://{host}/{i}", (page % body if "%s" in page else page).format(i=i))
            for k, (host, page) in enumerate(pages.items()) for i in range(60)]
    got = {r.page_id: r.text for r in styletree.extract(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = re.sub(r"</?p>", " ", body)
    for k in range(3):
        for i in range(60):
            assert " ".join(want.format(i=i).split()) in got[1000 * k + i], (k, got[1000 * k + i])
    assert "Latest links" not in got[5] and "Menu" not in got[1005]
    assert "Own report 7 with many words 7" in got[3007]


def test_pipeline_stages_and_columns(llm):
    import corpus_pipeline as P
    sf = "/root/testdata/sf0.001"
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for n, (_, stage) in enumerate(P.STAGES):
        before = docs.count()
        docs = stage(llm, docs, sf).cache()
        assert docs.count() <= before
        if n + 1 < len(P.STAGES):
            assert docs.columns == names
    rows = docs.collect()
    assert rows and all(r.lossless and r.n_tokens == len(r.ids) for r in rows)
    again = P.run(llm, sf).collect()
    assert {(r.doc_id, tuple(r.ids)) for r in again} == {(r.doc_id, tuple(r.ids)) for r in rows}


def test_pipeline_stages_on_odd_rows_and_empty_tables(llm, docs, odd):
    """Nulls, empty, long and repeated rows, clashing columns, no rows: each stage keeps its contract."""
    import corpus_pipeline as P
    sf = "/root/testdata/sf0.001"
    clash = ["1 AS ids", "2 AS decoded", "3 AS lid", "4 AS y", "5 AS `key`", "6 AS row", "7 AS fp", "8 AS _n", "'k' AS item_id"]
    plain = [(100 + i, f"Plain sentence number {i} about rivers, hills and the people who live beside them.") for i in range(20)]
    mixed = docs(odd + plain + plain[:3]).selectExpr("*", *clash)
    for df in (mixed, mixed.where("false"), docs([(1, None), (None, None), (1, "")])):
        n = df.count()
        for k, (name, stage) in enumerate(P.STAGES):
            out = stage(llm, df, sf)
            rows = out.collect()
            assert len(rows) <= n, name
            if k + 1 < len(P.STAGES):
                assert out.columns == df.columns, name
                if "ids" in df.columns:
                    assert all((r.ids, r.decoded, r.lid, r.y, r.key, r.row, r.fp, r._n, r.item_id)
                               == (1, 2, 3, 4, 5, 6, 7, 8, "k") for r in rows), name
            else:
                assert len(rows) == n and all(r.lossless for r in rows)


def test_pipeline_drops_what_each_stage_is_for(llm, docs):
    """One planted case a stage; the clean documents stay with their very text."""
    import corpus_pipeline as P
    sf = "/root/testdata/sf0.001"
    stages = dict(P.STAGES)
    words = "river hill stone bridge market garden window letter music winter harbour forest lantern meadow".split()
    rng = random.Random(12)
    clean = [(i, " ".join(rng.choice(words) for _ in range(120))) for i in range(12)]
    copies = [(50, clean[0][1]), (51, clean[1][1].upper())]
    left = {r.doc_id for r in stages["dedup"](llm, docs(clean + copies), sf).collect()}
    assert left == {i for i, _ in clean}
    item = llm.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    hurt = item[:10] + "q" + item[11:]
    leaks = [(60, "before " + item + " after"), (61, clean[2][1] + " " + hurt.upper())]
    left = {r.doc_id: r.text for r in stages["decontaminate"](llm, docs(clean + leaks), sf).collect()}
    assert left == dict(clean)
    own = [(70, "write to some.one@mail.example.org or +1 212 555 0100 from 10.1.2.3")]
    left = {r.doc_id: r.text for r in stages["private"](llm, docs(clean + own), sf).collect()}
    assert all(left[i] == t for i, t in clean)
    assert left[70] == "write to [EMAIL] or [PHONE] from [IP]"
