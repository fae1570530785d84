"""Chat formatting, the quality classifier, URL filters, BPE, HTML extraction and nearest neighbours."""

import base64
import collections
import datetime
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from glossloom.llm import ann, bpe, chat_format, html_extract, quality_resample, url_filters
from tests.llm.data import documents, frame, plain

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# --- chat -------------------------------------------------------------------------------------------------------------

PIECES = ["\\", "<", ">", "/", "s", "|", "[", "]", "INST", "im_end", "\n", "é", " ", *chat_format.CONTROL]
tricky = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


@given(tricky, tricky, tricky)
@settings(max_examples=400, deadline=None)
def test_template_round_trip(role, text, other):
    a, loss = chat_format.render(role, text)
    b, _ = chat_format.render("assistant", other)
    assert chat_format.parse(a + b) == [(role, text), ("assistant", other)]
    assert [chat_format.unescape(a[s["first"] : s["first"] + s["length"]]) for s in loss] == ([text] if role == "assistant" else [])
    inside = chat_format.escape(text)
    assert not any(c in inside for c in chat_format.CONTROL)


def test_chat_digest(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b</s>"), (1, 2, "user", None), (1, 3, "assistant", "[INST] é"), (2, 5, None, "x"), (None, None, None, None), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (3, 0, "a\nb", "y" * 100_000)]
    rows += [(4, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(3000)]
    events = chat_format.events_of(frame(spark, rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.digest(chat_format.formatted_parts(events)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        size = sum(len(chat_format.render(r, x)[0]) for _, r, x in turns)
        assert got[c] == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss), size)
    assert got.keys() == by.keys()


def test_chat_events(spark):
    log = [(1, 0, 1, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "he"), (1, 1, 3, "delta", None, "o"), (1, 1, 2, "delta", None, "ll"), (1, 0, 2, "edit", None, "hey"), (1, 2, 1, "delta", "assistant", "bad"), (1, 2, 2, "regenerate", None, None), (1, 2, 3, "delta", None, "good"), (1, 3, None, None, "user", "bye")]
    parts = chat_format.formatted_parts(plain(spark, log, "conv_id long, turn long, seq long, kind string, role string, text string"))
    text = "".join(r.formatted for r in sorted(parts.collect(), key=lambda r: (r.turn, r.nth)))
    assert chat_format.parse(text) == [("user", "hey"), ("assistant", "hello"), ("assistant", "good"), ("user", "bye")]
    tied = [(1, 0, 1, "message", "user", "a"), (1, 0, 2, "edit", None, "x"), (1, 0, 2, "delta", None, "x"), (1, 0, 2, "regenerate", None, None), (1, 0, 2, "delta", None, "w"), (2, 0, 1, "delta", "user", "z"), (2, 0, 1, "message", "user", "y")]
    for order in (tied, tied[::-1]):
        parts = chat_format.formatted_parts(plain(spark, order, "conv_id long, turn long, seq long, kind string, role string, text string"))
        assert [chat_format.parse(r.formatted) for r in parts.orderBy("conv_id").collect()] == [[("user", "xwx")], [("user", "yz")]]
    with pytest.raises(Exception, match="unknown kind"):
        chat_format.formatted_parts(plain(spark, [(1, 0, 1, "odd", "user", "x")], "conv_id long, turn long, seq long, kind string, role string, text string")).count()


# --- quality ----------------------------------------------------------------------------------------------------------


def _labelled(n=900):
    rng = random.Random(2)
    vocabulary = ["w" + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(500)]
    rows, labels, bad = [], [], set()
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(3, 80))]
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["scum", "trash"]))
            bad.add(i)
        elif i % 7 == 0:
            w = [f"{x} %%%" for x in w]
            bad.add(i)
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(i % 7 != 0 or i % 5 == 0), int(i % 5 == 0)))
    return rows, labels, bad


def test_quality_classifier_held_out(spark):
    rows, labels, bad = _labelled()
    docs, table = frame(spark, rows), plain(spark, labels, "doc_id long, quality int, toxic int")
    out = quality_resample.resample(docs, table).collect()
    kept = {r.doc_id for r in out if r.kept}
    unseen = {i for i, _ in rows} - {x[0] for x in labels}
    assert len(unseen & bad & kept) <= 0.05 * len(unseen & bad)
    assert len((unseen - bad) - kept) <= 0.02 * len(unseen - bad)
    stays = quality_resample.kept(docs, table)
    assert stays.schema == docs.schema and {r.doc_id for r in stays.collect()} == kept


@pytest.mark.parametrize("sharpness", [1.0, 16.0])
def test_quality_by_hand(spark, sharpness):
    """Weights from exact counts of n-grams, and the k largest keys."""
    import math
    import re

    rows, labels, _ = _labelled(200)
    rows += [(500, None), (501, ""), (502, "same " * 40), (503, "trash, trash! w"), (503, "trash, trash! w")]
    good = {i for i, q, t in labels if q and not t}
    every, target, of = collections.Counter(), collections.Counter(), []
    for i, text in rows:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+", (text or "").lower())
        own = [[("word", x)] + [("pair", x, y) for y in w[k + 1 : k + 2]] + [("begin", x[:4])] * (len(x) > 4) + [("repeat",)] * (len(w) >= k + 8 and set(w[k : k + 8]) == {x}) for k, x in enumerate(w)]
        of.append(own)
        met = {g for at in own for g in at}
        every.update(met)
        target.update(met if i in good else ())
    usual = sum(i in good for i, _ in rows) / len(rows)

    def value(g):
        seen, due = target[g] + 1, every[g] * usual + 1
        r = math.log(seen / due)
        return math.copysign(max(0, abs(r) - 2 * math.sqrt(1 / seen + 1 / due)), r)

    def weight(own):
        sums = [sum(map(value, g)) for g in own]
        return min([0, *(sum(sums[max(0, k) : k + 8]) for k in range(-4, len(sums), 4))])

    docs, table = plain(spark, rows), plain(spark, labels, "doc_id long, quality int, toxic int")
    for k in (0, 1, 60, len(rows)):
        out = quality_resample.resample(docs, table, k=k, sharpness=sharpness).collect()
        got, want = collections.defaultdict(list), collections.defaultdict(list)
        for r in out:
            got[r.doc_id].append((r.n_grams, r.log_weight))
        for (i, _), own in zip(rows, of, strict=True):
            want[i].append((sum(map(len, own)), weight(own)))
        for i, ws in want.items():
            assert all(a == c and abs(b - d) < 1e-4 for (a, b), (c, d) in zip(sorted(got[i]), sorted(ws), strict=True))
        keys = sorted((r.gumbel_key for r in out), reverse=True)
        assert all(r.kept == (k > 0 and r.gumbel_key >= keys[k - 1]) for r in out)
        assert len({round(r.gumbel_key - sharpness * r.log_weight, 6) for r in out}) >= len(out) - 1


def test_quality_draws_in_proportion(spark):
    """At sharpness 1 the noise is Gumbel's: of two documents the likelier one comes first as often as its weight says."""
    noise = [r.n for r in spark.range(40_000).select(quality_resample._noise("id", "id").alias("n")).collect()]
    a, b = np.array(noise[::2]), np.array(noise[1::2])
    for ratio in (1, 3, 10):
        assert abs((a + np.log(ratio) > b).mean() - ratio / (1 + ratio)) < 0.015


def test_quality_edge_cases(spark):
    rows, labels, _ = _labelled(300)
    odd = [(None, None), (None, "scum"), (1000, ""), (1001, None), (1002, "\n\t"), (1003, "scum " * 50_000), (1000, "")]
    table = plain(spark, [*labels, (None, 1, 0), (2, None, None), (4, 1, None)], "doc_id long, quality int, toxic int")
    out = quality_resample.resample(frame(spark, rows + odd), table).collect()
    assert len(out) == len(rows + odd)
    assert all(r.log_weight == 0 for r in out if r.n_grams == 0)
    none = plain(spark, [], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in quality_resample.resample(frame(spark, rows), none).collect())
    assert quality_resample.resample(frame(spark, []), none).count() == 0
    clash = frame(spark, rows).withColumnsRenamed({"fp": "log_weight", "part": "gumbel_key", "id": "N_grams_"})
    assert quality_resample.kept(clash, table).schema == clash.schema


@pytest.mark.parametrize("k", [0, 1, 7, 250, 300, 1000])
def test_gumbel_top_k(spark, k):
    rng = np.random.default_rng(k)
    keys = np.round(rng.normal(size=300), 2)
    scored = plain(spark, [(float(x),) for x in keys], "gumbel_key double")
    least = quality_resample.cutoff(scored, k)
    want = -np.inf if k >= len(keys) else np.inf if k == 0 else np.sort(keys)[::-1][k - 1]
    assert least == want or (k == 300 and least == keys.min())


# --- urls -------------------------------------------------------------------------------------------------------------


def test_url_filters(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    urls = ["http://A.b.example.com/x/y?q=1", "https://example.com", "http://u:p@b.example.com:80/x/", "nonsense", None, "http://notexample.com/x/y", "http:///", "ftp://b.example.com/x", "http://[2001:db8::1]:80/x/y", "http://b.example.com" + "/x" * 20_000, "http://b.example.com/x/" + "y" * 100_000]
    captures = [(i, u, day(t)) for t in range(0, 60, 10) for i, u in enumerate(urls)] + [(9, "http://example.com/", None)]
    changes = [("l", "domain", "Example.com", "add", day(5)), ("l", "domain", "example.com", "add", day(8)), ("l", "domain", "example.com", "remove", day(20)), ("l", "domain", "example.com", "add", day(20)), ("l", "domain", "example.com", "add", day(40)), ("m", "prefix", "b.example.com/x/", "add", day(10)), ("m", "host", "b.example.com", "add", day(30)), ("m", "host", "b.example.com", "remove", day(50)), ("m", "url", "https://example.com", "add", day(0)), (None, "url", "x", "add", day(0)), ("l", "host", None, "add", day(0)), ("l", "host", "a", "remove", day(1)), ("m", "host", "[2001:db8::1]", "add", day(12)), ("m", "prefix", "[2001:db8::1]/x/", "add", day(20)), ("m", "prefix", "b.example.com/x/x/x/", "add", day(20)), ("l", "domain", "com", "add", day(50))]

    def active(entry, t):
        past = sorted((s, a == "remove") for lst, k, v, a, s in changes if None not in (lst, k, v) and (lst, k, v.lower()) == entry and s <= t)
        return bool(past) and not past[-1][1]

    def keys(u):
        from urllib.parse import urlsplit

        p = urlsplit(u)
        if not p.hostname:
            return set()
        host = f"[{p.hostname}]" if ":" in p.hostname else p.hostname
        labels, steps = host.split("."), p.path.split("/")
        return {("url", u.lower()), ("host", host)} | {("domain", ".".join(labels[i:])) for i in range(len(labels))} | {("prefix", (host + "/".join(steps[:i]) + "/").lower()) for i in range(1, min(len(steps), 6) + 1)}

    entries = {(lst, k, v.lower()) for lst, k, v, *_ in changes if None not in (lst, k, v)}
    want = collections.Counter()
    for i, u, t in captures:
        hits = [e for e in entries if u and t and e[1:] in keys(u) and active(e, t)]
        want[i, u, t, len(hits), ",".join(sorted({e[0] for e in hits})), bool(hits)] += 1
    schema = "list string, kind string, value string, action string, since date"
    got = url_filters.judged(frame(spark, captures, "page_id long, url string, fetched date"), plain(spark, changes, schema))
    assert collections.Counter(map(tuple, got.collect())) == want
    assert url_filters.judged(frame(spark, captures, "page_id long, url string, fetched date"), plain(spark, [], schema)).where("blocked").count() == 0


# --- BPE --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return bpe.Tokenizer(RANKS, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ids(encoded):
    ids, offsets = encoded
    return [ids[a:z].tolist() for a, z in zip(offsets[:-1], offsets[1:], strict=True)]


def test_bpe_is_tiktoken(tokenizers):
    ours, theirs = tokenizers

    @given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab theinÉ日'1 \n", max_size=300), st.text(alphabet="abt", min_size=60, max_size=400), st.text(alphabet="ainerstu", min_size=60, max_size=200)), max_size=3))
    @settings(max_examples=250, deadline=None)
    def same(texts):
        encoded = ours.encode(texts)
        assert _ids(encoded) == [theirs.encode_ordinary(t) for t in texts]
        assert ours.decode(*encoded) == [t.encode() for t in texts]
        assert [x or "" for x in bpe._joined(*encoded).to_pylist()] == [",".join(map(str, ids)) for ids in _ids(encoded)]
        assert _ids(bpe._parted(bpe._joined(*encoded))) == _ids(encoded)

    same()
    for text in ("a" * 20_000, "ab" * 5000, "日本" * 3000):
        assert _ids(ours.encode([text])) == [theirs.encode_ordinary(text)]


def test_bpe_decodes_long_texts_in_pieces(tokenizers, monkeypatch):
    texts = ["", "one", "many words " * 50, "", "é日 " * 40, "two of them", ""]
    for piece, every in ((1, 1), (7, 20), (10, 1000)):
        monkeypatch.setattr(bpe, "PIECE", piece)
        monkeypatch.setattr(bpe, "DECODED_IDS", every)
        assert tokenizers[0].decode(*tokenizers[0].encode(texts)) == [t.encode() for t in texts]


def test_bpe_decodes_the_ids(tokenizers):
    ids, offsets = tokenizers[0].encode(["one text", "", "another of them"])
    for i in range(len(ids)):
        other = ids.copy()
        other[i] = ids[i] % 5000 + 300
        want = [tokenizers[1].decode_bytes(x) for x in _ids((other, offsets))]
        assert tokenizers[0].decode(other, offsets) == want
    ids[0] = 10_000_000
    with pytest.raises(ValueError, match="vocabulary"):
        tokenizers[0].decode(ids, offsets)


def test_bpe_query(spark, tokenizers):
    docs = documents()
    encoded = bpe.encode(frame(spark, docs), RANKS, PATTERN)
    want = collections.Counter()
    for i, t in docs:
        ids = tokenizers[1].encode_ordinary(t or "")
        want[i, len(ids), sha(",".join(map(str, ids))), sha(t or "")] += 1
    assert collections.Counter(map(tuple, bpe.digest(encoded).collect())) == want
    back = bpe.decode(encoded, RANKS, PATTERN)
    assert collections.Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == collections.Counter((i, (t or "").encode()) for i, t in docs)
    assert bpe.encode(frame(spark, []), RANKS, PATTERN).count() == 0


# --- pages ------------------------------------------------------------------------------------------------------------

ARTICLE = "<h1>Title &amp; more</h1><p>First <b>pa</b>ra&#103;raph.<br>Next\n line</p><p>Ti.</p><ul><li>one</li><li>two</li></ul>"
TEXT = "Title & more First paragraph. Next line Ti. one two"
AROUND = "<nav><a href=/>Home</a><a href=/b>B</a></nav><div class='cookie-notice'>We use cookies, a long notice about them that says nothing.</div><div id=sidebar><p>Other things that are long enough to be taken for text.</p></div>"
AFTER = "<section id='comments'><article class='comment'><p>I liked this very much, it is a long comment with many words.</p></article></section><form><label>Name</label></form><div class='ad-banner'>Buy</div><footer>&copy; us</footer>"


@pytest.mark.parametrize("box", ["article", "main", "div id=content", "div class='wrap with-sidebar'", "section"])
def test_html_templates(box):
    page = f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body><header><a href=/>Site</a></header>{AROUND}<{box}>{ARTICLE}</{box.split()[0]}>{AFTER}<script>var a='<p>no</p>';</script></body></html>"
    assert html_extract.main_text(page) == TEXT


INSIDE = [
    ("<ul><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li><li><a href=/3>Third source</a></li></ul>", "First source Second source Third source"),
    ("<p class='social-history'>Of social history.</p><p id='banner-bearers'>Those who bore banners.</p><h2 id='related'>Related</h2>", "Of social history. Those who bore banners. Related"),
    ("<section class='related-work'><p>Others did this.</p></section>", "Others did this."),
    ("<div class='share-buttons'><a href=/s>Share</a></div><div id='cookieNotice'>We use cookies.</div><p class='ad'>Buy.</p>", ""),
    ("<header><p>By the author</p></header><blockquote>Said\n\tshe</blockquote><table><tr><td>1<td>2</table>", "By the author Said she 1 2"),
    ("<![foo[x]]><!-- a > b --><p title='a>b'>Odd</p><?x y?>", "Odd"),
    ("<!-- left out --!><p>a &lt; b &#x26; c&nbsp;d</p>", "a < b & c d"),
]


@pytest.mark.parametrize("box", ["article", "main"])
@pytest.mark.parametrize(("html", "text"), INSIDE)
def test_html_inside_articles(box, html, text):
    page = f"<body>{AROUND}<{box}>{ARTICLE}{html}<p>The last paragraph.</p></{box}>{AFTER}"
    assert html_extract.main_text(page) == f"{TEXT} {text} The last paragraph.".replace("  ", " ")


def test_html_generated_pages():
    """Pages made of parts with known text, in many arrangements."""
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("the of and river bridge town stone water light over under between".split()) for _ in range(n)).capitalize() + "."
    links = lambda n: "".join(f"<li><a href='/{k}'>{words(2)}</a></li>" for k in range(n))
    menus = [lambda: f"<nav><ul>{links(6)}</ul></nav>", lambda: f"<div class='{rng.choice(('main-menu', 'topbar', 'breadcrumbs'))}'><ul>{links(4)}</ul></div>", lambda: f"<header><a href='/'>{words(2)}</a><p>{words(6)}</p></header>"]
    others = [lambda: f"<aside><p>{words(30)}</p></aside>", lambda: f"<div class='ad {rng.choice(('slot-1', 'top', 'box'))}'>{words(20)}</div>", lambda: f"<div id='cookie-notice'><p>{words(25)}</p><button>{words(1)}</button></div>", lambda: f"<form>{words(4)}<input></form>", lambda: f"<script>var x = '<p>{words(9)}</p>';</script>", lambda: f"<style>p {{}}</style><!-- {words(5)} -->"]
    ends = [lambda: f"<section class='{rng.choice(('comments', 'comment-list', 'user-comments'))}'><div class='comment'><p>{words(40)}</p></div><div class='comment'>{words(12)}</div></section>", lambda: f"<footer>{words(12)}</footer>", lambda: f"<div role='contentinfo'>{words(9)}</div>"]
    for _ in range(300):
        want, html = [], ""
        for k in range(rng.randint(2, 9)):
            w = words(rng.randint(15, 60) if k < 2 else rng.choice((1, 3, 30, 70)))
            want.append(w)
            html += rng.choice((f"<p>{w}</p>", f"<p>{w}", f"<p><b>{w}</b></p>", f"<div>{w}</div>", f"<p>\n  {w.replace(' ', chr(10) + ' ')}\t</p>"))
            if rng.random() < 0.2:
                html += rng.choice(others)()
        title = words(5)
        box = rng.choice(("article", "main", "div id='content'", "section", "div class='post-body'"))
        page = "".join(m() for m in rng.sample(menus, rng.randint(0, 3))) + "".join(o() for o in rng.sample(others, rng.randint(0, 3)))
        page += f"<{box}><h1>{title}</h1>{html}</{box.split()[0]}>" + "".join(e() for e in rng.sample(ends, rng.randint(0, 3)))
        assert html_extract.main_text(f"<html><head><title>{words(3)}</title></head><body>{page}</body></html>") == " ".join([title, *want]), page


@pytest.mark.parametrize("piece", ["<a ", '<a x="', "<!--", "</", "<!", "<?", "<![", "<a x='y\"", "<", "&", "<script>", "<p>", "<a/", "<div class='a"])
def test_html_takes_linear_time(piece):
    import time

    began = time.process_time()
    for end in ("", ">", "'>"):
        html_extract.main_text(piece * (1_000_000 // len(piece)) + end)
    assert time.process_time() - began < 30


def test_html_edge_cases(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "plain &lt;text&gt;"), (None, None, "<p>a<p>b"), (4, "u", "<div>" * 5000 + "deep" + "</div>" * 10), (5, "u", "<p>" + "word " * 200_000 + "</p>"), (6, "u", "<nav>only</nav>"), (7, "u", "<p>x &am"), (7, "u", "<p>x &am")]
    got = html_extract.digest(html_extract.extract(frame(spark, pages, "page_id long, url string, html string"))).collect()
    texts = collections.Counter((r.page_id, r.url, r.text if len(r.text) < 50 else len(r.text), r.n_chars) for r in got)
    assert texts == {(1, "u", "", 0): 1, (2, None, "", 0): 1, (3, "u", "plain <text>", 12): 1, (None, None, "a b", 3): 1, (4, "u", "deep", 4): 1, (5, "u", 999_999, 999_999): 1, (6, "u", "", 0): 1, (7, "u", "x &am", 5): 2}


# --- neighbours -------------------------------------------------------------------------------------------------------


def _recall(spark, vectors, k=20):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors]
    from pyspark.sql import functions as F

    got = collections.defaultdict(list)
    for r in ann.nearest(frame(spark, rows, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0, k=k).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = {}
    for i, v in vectors:
        if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = np.asarray(np.asarray(v, np.float32), float)
    found = total = 0
    for q in (i for i in good if i % 20 == 0):
        best = sorted(((-(good[q] * v).sum(), i) for i, v in good.items() if i != q))[:k]
        mine = sorted(got.get(q, ()))
        assert [r for r, *_ in mine] == list(range(1, len(best) + 1))
        assert all(abs((good[q] * good[i]).sum() - s) < 1e-12 for _, i, s in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        found, total = found + len({i for _, i, _ in mine} & {i for _, i in best}), total + len(best)
    assert got.keys() == {i for i in good if i % 20 == 0 and len(good) > 1}
    return found / max(1, total)


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1500, 16)) * rng.uniform(0.2, 3, (1500, 1))
    v[100:400] = v[0]  # one very common vector
    v[400:600] = v[1] + rng.normal(size=(200, 16)) * 0.01
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(3000, None), (3020, [0.0] * 16), (3040, [None] + [1.0] * 15), (3060, [float("nan")] + [1.0] * 15), (3080, [float("inf")] * 16), (3100, [1.0, 2.0]), (None, [1.0] * 16), (3120, [])]
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    assert _recall(spark, rows) >= 0.9


def test_few_neighbours(spark):
    rng = np.random.default_rng(9)
    assert _recall(spark, [(i, rng.normal(size=16).tolist()) for i in range(12)]) == 1
    assert _recall(spark, [(0, [1.0] * 16)]) == 0
    assert _recall(spark, [(i, [1.0] * 16) for i in range(0, 100, 10)], 3) == 1
    assert _recall(spark, []) == 0


def test_neighbours_of_repeated_rows(spark):
    """Each row is a candidate and each query row has its list, against brute force."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(10)
    base = [(i, x) for i, x in enumerate(rng.integers(-3, 4, (30, 16)).astype(float))]
    for rows in (base * 2, base + base[1:2] * 50, base + base[:1] + [(0, base[5][1]), (3, base[4][1]), (3, base[7][1])]):
        want = collections.Counter()
        for i, q in rows:
            if i % 20 == 0:
                best = sorted((-float(q @ v), j) for j, v in rows if j != i)[:20]
                want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(best))
        got = ann.nearest(frame(spark, [(i, x.tolist()) for i, x in rows], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0)
        assert collections.Counter(map(tuple, got.collect())) == want


def test_neighbours_in_clusters(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(13)
    v = (rng.normal(size=(300, 32)) * 3)[rng.integers(0, 300, 12_000)] + rng.normal(size=(12_000, 32)) * 0.4
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in ann.nearest(rows, F.col("id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    scores = v[::100] @ v.T
    scores[np.arange(120), np.arange(0, 12_000, 100)] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(got[100 * q] & set(best[q].tolist())) / 20 for q in range(120)]) >= 0.9


def test_neighbours_of_sampled_queries(spark, monkeypatch):
    # so few sample rows that the first stands for the k-th: a query in the sample is not that itself
    monkeypatch.setattr(ann, "SAMPLE", 60)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(12)
    v = rng.normal(size=(8000, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    sampled = [r.vec_id for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(60).collect()]
    got = collections.defaultdict(set)
    for r in ann.nearest(rows, F.col("id").isin(sampled), k=5).collect():
        got[r.query_id].add(r.vec_id)
    scores = v @ v.T
    np.fill_diagonal(scores, -np.inf)
    best = np.argsort(-scores, axis=1)[:, :5]
    assert np.mean([len(got[q] & set(best[q].tolist())) / 5 for q in sampled]) >= 0.9
