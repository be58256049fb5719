"""Site style tree: attributes, depth, and importance against a plain recomputation."""

import collections
import math
import random
import time

import pytest

from mountwait.llm import styletree


def text(page, low=(), heavy=()):
    return styletree.main_text(page, set(low), set(heavy))


@pytest.mark.parametrize("inside", [
    '<div style="overflow:hidden">kept</div>', '<div aria-hidden="false">kept</div>', '<p title="a hidden gem">kept</p>',
    '<p data-class="widget">kept</p>', '<p class="share-price">kept</p>', '<p class="side-by-side">kept</p>',
    '<p id="form-of-life">kept</p>', '<svg width="1"/><p>kept</p>', '<math/><p>kept</p>', "<p data-x='class=\"ads\"'>kept</p>",
    '<p alt="role=navigation">kept</p>', '<p class=plain class=advert>kept</p>', '<p><svg viewBox="0 0 1 1" />kept</p>'])
def test_attribute_text_is_no_name(inside):
    """No name speaks against the text: values of other attributes, longer names, a repeated attribute."""
    page = f"<html><body><div><p>{'much other text. ' * 20}</p>{inside}<p>end</p></div></body></html>"
    assert text(page).endswith("kept end")


@pytest.mark.parametrize("inside", [
    "<div hidden>gone</div>", '<div class="x" hidden="">gone</div>', '<div class="comment-list">gone</div>',
    '<div id="siteFooter">gone</div>', '<ul role="navigation"><li>gone</li></ul>', "<div class=cookie-banner>gone</div>",
    '<svg><text>gone</text></svg>', '<div class="grid ads">gone</div>', '<p class="ad-slot">gone</p>'])
def test_names_that_speak_against_text(inside):
    page = f"<html><body><div><p>{'much other text. ' * 20}</p>{inside}<p>end</p></div></body></html>"
    assert "gone" not in text(page) and text(page).endswith("text. end")


@pytest.mark.parametrize("tag", ["div", "blockquote", "ul", "section"])
def test_time_grows_with_the_page_however_deep(tag):
    def page(n):
        return "<html><body>" + "".join(f"<{tag} class=c{i % 7}>word{i} " for i in range(n))
    t0 = time.perf_counter()
    styletree.signatures("h", page(20_000))
    got = text(page(20_000))
    took = time.perf_counter() - t0
    assert got.split() == [f"word{i}" for i in range(20_000)]
    assert took < 4  # two passes; quadratic work took minutes


def brute_low(pages):
    """host -> paths of little importance, by whole texts and plain counts."""
    rows = collections.defaultdict(set)  # (host, path, kind) -> {(signature, main content, page)}
    for host, page in pages:
        blocks, elements = styletree.parse(page)
        own = [(n, t) for n, t in blocks if t and not n.none]

        def chain(n):
            while n.up:
                yield n
                n = n.up
        content = collections.defaultdict(list)
        for n, t in own:
            for e in chain(n):
                content[e.path].append(t.lower().replace(host, "@") if host else t.lower())
        inside_total = [len(t) for n, t in own if n.main]
        use = [b for b in own if b[0].main] if 2 * sum(inside_total) >= sum(len(t) for _, t in own) else own
        held = collections.Counter()
        for n, t in use:
            for e in chain(n):
                held[e.path] += len(t)
        total, best = sum(len(t) for _, t in use), ()
        for n, _ in use:
            for e in chain(n):
                if 2 * held[e.path] > total and e.depth > len(best):
                    best = (e.path,) * e.depth
        main = tuple(content[best[0]]) if best else tuple(t.lower().replace(host, "@") if host else t.lower() for _, t in own)
        for p, texts in content.items():
            if any(e.path == p and e.tag in styletree.NEVER_LOW for e in elements):
                continue
            kind = 2 * any(e.path == p and e.main for e in elements)
            style = tuple(tuple(e.children) for e in elements if e.path == p and not e.none)
            rows[host, p, kind].add((tuple(texts), main, page))
            rows[host, p, kind + 1].add((style, main, page))

    def entropy(found):
        sigs = collections.defaultdict(lambda: (set(), set()))
        for sig, main, page in found:
            sigs[sig][0].add(page), sigs[sig][1].add(main)
        n = [len(a) for a, _ in sigs.values()]
        m = [len(b) for _, b in sigs.values()]
        use = n if sum(m) < styletree.TEMPLATE * sum(n) else m
        k = sum(use)
        return sum(n), (k, 1.0) if k < 2 else (k, (math.log(k) - sum(x * math.log(x) for x in use) / k) / math.log(k))
    every = collections.defaultdict(set)
    for (_, p, kind), found in rows.items():
        every[p, kind] |= found
    best = collections.defaultdict(float)
    for (host, p, kind), found in rows.items():
        _, (k, imp) = entropy(found)
        _, (ka, imp_all) = entropy(every[p, kind])
        trust, share = ka / (ka + styletree.EVIDENCE), k / (k + styletree.SHRINK)
        whole = trust * imp_all + 1 - trust
        best[host, p] = max(best[host, p], (share * imp + (1 - share) * whole) * (2 if kind > 1 else 1))
    low = collections.defaultdict(set)
    for (host, p), imp in best.items():
        if imp < styletree.THRESHOLD:
            low[host].add(p)
    return low


def test_importance_equals_plain_counts(llm):
    """Pages without article elements on two hosts: template, varying and half-varying branches."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    pages = []
    for i in range(160):
        host = ("a.org", "b.org")[i % 4 == 0]
        body = (f"<div class=top>welcome to {host} <b>today</b></div><div class=box>{rnd.choice(['x y', 'z'])}<ul><li>one<li>two</ul></div>"
                f"<div class=story><p>{say(40)}</p>{'<p>' + say(9) + '</p>' if i % 3 else ''}</div><div class=end>bye</div>")
        pages.append((f"http://{host}/{i}", f"<html><body>{body}</body></html>"))
    pages += pages[:7]
    df = llm.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    got = {r.host: set(r.low) for r in styletree.low_branches(df, "url", "html").collect()}
    want = brute_low([(styletree.host_of(u), h) for u, h in dict.fromkeys(pages)])
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert any(want.values())
    for r in styletree.extract(df).collect():
        assert "welcome" not in r.text and "bye" not in r.text and len(r.text.split()) >= 40
