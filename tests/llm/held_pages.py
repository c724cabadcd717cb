"""Page styles marked by hand, none of which training makes; [[...]] is main text."""

import random
import re
from collections import Counter

from linewright.llm import html_text

STYLES = {
    "blog": """<html><head><title>{s}</title></head><body class="home blog"><div id="hd"><h2>{s}</h2><ul><li><a href="/">{s}</a></li><li><a href="/a">{s}</a></li><li><a href="/b">{s}</a></li></ul></div>
      <div id="bd"><div class="hentry"><h1>[[{s}]]</h1><p>[[{l}]]</p><p>[[{l}]]</p><h2>[[{s}]]</h2><p>[[{l}]]</p><p>[[{l}]]</p></div>
      <div id="rightcol"><h3>{s}</h3><ul><li><a href="/1">{s}</a></li><li><a href="/2">{s}</a></li><li><a href="/3">{s}</a></li></ul></div></div><div id="ft"><p>&copy; {s}</p></div></body></html>""",
    "manual": """<html><body><div role="navigation"><ul><li><a href="/1">{s}</a></li><li><a href="/2">{s}</a></li><li><a href="/3">{s}</a></li><li><a href="/4">{s}</a></li></ul></div><div role="main"><h1>[[{s}]]</h1><p>[[{l}]]</p><ol><li>[[{m}]]</li><li>[[{m}]]</li><li>[[{m}]]</li></ol><p>[[{l}]]</p><pre>[[{m}]]</pre><p>[[{l}]]</p></div><div role="contentinfo"><p>{s}</p></div></body></html>""",
    "old tables": """<html><body><table><tr><td colspan=2><b>{s}</b></td></tr><tr><td><p><a href="/1">{s}</a></p><p><a href="/2">{s}</a></p><p><a href="/3">{s}</a></p></td><td><h1>[[{s}]]</h1><p>[[{l}]]</p><p>[[{l}]]</p><p>[[{l}]]</p></td></tr><tr><td colspan=2>&copy; {s}</td></tr></table></body></html>""",
    "newspaper": """<html><body><div class="gdpr-overlay"><p>{m}</p><p><a href="/ok">{s}</a></p></div><header><div class="brand">{s}</div><nav><a href="/1">{s}</a> <a href="/2">{s}</a> <a href="/3">{s}</a></nav></header>
      <div class="story-body"><h1>[[{s}]]</h1><p>[[{l}]]</p><div class="mpu"><p>{s}</p></div><p>[[{l}]]</p><p>[[{l}]]</p><blockquote>[[{m}]]</blockquote><p>[[{l}]]</p></div>
      <div id="disqus_thread"><h3>{s}</h3><div class="post-message"><p>{s}</p><p>{m}</p></div><div class="post-message"><p>{s}</p><p>{m}</p></div></div><footer><p>{s}</p></footer></body></html>""",
    "bare": """<html><body><ul><li><a href="/1">{s}</a><li><a href="/2">{s}</a><li><a href="/3">{s}</a></ul><h1>[[{s}]]</h1><p>[[{l}]]<p>[[{l}]]<p>[[{l}]]<p>[[{l}]]<hr><address>{s}</address></body></html>""",
    "app": """<html><body><div class="x1"><a href="/1">{s}</a><a href="/2">{s}</a><a href="/3">{s}</a></div><div class="x2"><div class="x3"><div class="x4">[[{l}]]</div><div class="x4">[[{l}]]</div><div class="x4">[[{l}]]</div></div></div><form><p>{s}</p><input></form><div class="x9">{s}</div></body></html>""",
}
RANGES = {"s": (1, 6), "m": (8, 30), "l": (30, 120)}


def filled(style, bag, rng):
    """The page and its blocks of main text."""
    page = re.sub(r"\{(\w)\}", lambda m: " ".join(rng.choice(bag) for _ in range(rng.randrange(*RANGES[m[1]]))), STYLES[style])
    return page.replace("[[", "").replace("]]", ""), re.findall(r"\[\[(.*?)\]\]", page)


def evaluate(network, pages, times=20):
    """For each style the mean F1 of the words of main text that are found."""
    rng, out = random.Random(3), {}
    bag = [w for p in pages[:50] for b in html_text.leaf_blocks(p) for w in re.findall(r"[^\W\d_]{2,}", b.text)]
    for style in STYLES:
        made = [filled(style, bag, rng) for _ in range(times)]
        scores = []
        for text, (_, wanted) in zip(html_text.main_text(network, [p for p, _ in made]), made, strict=True):
            got, want = text.split("\n"), [" ".join(w.split()) for w in wanted]
            common = sum(len(x.split()) for x in got if x in want)
            scores.append(2 * common / max(1, len(text.split()) + sum(len(x.split()) for x in want)))
        out[style] = round(sum(scores) / times, 3)
    return out


#: Names of a block of readers' comments and of one comment; the second pair is in no list of the library.
COMMENT_NAMES = {"telling": ("comments", "comment"), "unknown": ("zq-thread", "zq-entry"), "none": None}


def evaluate_comments(network, pages, kind):
    """The mean F1 of words over pages with one article, after readers' comments were put at its end; those are not wanted."""
    rng, given, wanted = random.Random(1), [], []
    bag = [w for p in pages[:50] for b in html_text.leaf_blocks(p) for w in re.findall(r"[^\W\d_]{2,}", b.text)]
    outer, inner = (f' class="{x}"' for x in COMMENT_NAMES[kind]) if COMMENT_NAMES[kind] else ("", "")
    some = lambda low, high: " ".join(rng.choice(bag) for _ in range(rng.randint(low, high)))
    for page in pages:
        start, end = html_text.article_of(page)
        said = "".join(f"<div{inner}><p><b>{some(1, 2)}</b></p><p>{some(5, 60)}</p></div>" for _ in range(rng.randint(1, 5)))
        given.append(f"{page[:end]}<section{outer}><h3>{some(1, 3)}</h3>{said}</section>{page[end:]}")
        wanted.append(Counter(w for b in html_text.leaf_blocks(page[start:end]) for w in b.text.split()))
    scores = []
    for text, want in zip(html_text.main_text(network, given), wanted, strict=True):
        got = Counter(text.split())
        scores.append(2 * (got & want).total() / max(1, got.total() + want.total()))
    return sum(scores) / len(scores)
