"""Byte-level BPE, decontamination, shards and page text against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tessera.llm.bpe import Encoder, bpe_decode, bpe_encode, read_ranks
from tessera.llm.common import table
from tessera.llm.decontaminate import ItemAutomaton, find_contamination, merged
from tessera.llm.html_text import extract_text, main_text
from tessera.llm.queries import QUERIES
from tessera.llm.shard import shard_by_size

from .helpers import frame, odd_rows

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_50k.tiktoken")


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def test_bpe_query_equals_tiktoken(spark):
    ref = reference()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    rows = QUERIES["op2_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ref.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_odd_texts_and_long_pretokens():
    ref, enc = reference(), Encoder(read_ranks(RANKS), P.PATTERN)
    r = random.Random(3)
    texts = ["".join(r.choice("abcdehlotn ’é中1  !\n\t\x1c\x85 ") for _ in range(r.randint(0, 200))) for _ in range(400)]
    texts += ["", " ", "  ", "a" * 3000, "ab" * 4000, " the" * 500, "the" * 2000, "x \ny", " x", "x ", "don't we'll I'M"]
    got = enc.encode_batch(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ref.encode_ordinary(t) for t in texts]
    assert enc.encode_batch(texts) == got and [enc.decode(g).decode() for g in got] == texts


def test_bpe_rows(spark):
    df = frame(spark, odd_rows())
    coded = bpe_encode(df, RANKS, P.PATTERN)
    back = bpe_decode(coded, RANKS, P.PATTERN).collect()
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in back) == sorted((str(i), t or "") for i, t in odd_rows())
    assert bpe_encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def brute_hits(words, items, window):
    hit, found = set(), set()
    for item, iw in items:
        wins = {tuple(iw[k : k + window]) for k in range(len(iw) - window + 1)} if len(iw) >= window else ({tuple(iw)} if iw else set())
        for w in wins:
            for k in range(len(words) - len(w) + 1):
                if tuple(words[k : k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    found.add(item)
    return hit, found


@pytest.mark.parametrize("window", [2, 3, 5])
def test_automaton_against_brute_force(window):
    r = random.Random(window)
    for _ in range(150):
        letters = [bytes([c]) for c in b"abcd"[: r.randint(1, 4)]]
        items = [(k, [r.choice(letters) for _ in range(r.randint(0, 9))]) for k in range(r.randint(0, 6))]
        doc = [r.choice(letters + [b"z"]) for _ in range(r.randint(0, 30))]
        runs, found = ItemAutomaton(items, window).scan(doc)
        hit, held = brute_hits(doc, items, window)
        assert {k for a, b in runs for k in range(a, b)} == hit and found == held and runs == merged(runs)


def test_decontaminate_query(spark):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(r["item_id"], split(r["text"])) for r in table(spark, SF, "benchmark").collect()]
    texts = {r["doc_id"]: split(r["text"]) for r in table(spark, SF, "documents").collect()}
    rows = QUERIES["op3_decontaminate"](spark, SF).collect()
    assert len(rows) == len(texts) and any(r["contaminated"] for r in rows)
    for r in rows:
        hit, found = brute_hits(texts[r["doc_id"]], items, 10)
        names = ",".join(sorted(map(str, found)))
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(texts[r["doc_id"]]), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(names.encode()).hexdigest()


def test_decontaminate_rows(spark):
    items = spark.createDataFrame([(1, "w1 w2"), (2, None), (None, "the the"), (3, ""), (4, "ONE"), (4, "one")], "item_id long, text string")
    got = find_contamination(frame(spark, odd_rows()), items, cleaned=True).collect()
    assert len(got) == len(odd_rows())
    one = next(r for r in got if r["doc_id"] == 4)
    assert (one["items"], one["cleaned"], [tuple(s) for s in one["spans"]]) == ([4], "", [(0, 1)])
    assert find_contamination(frame(spark, odd_rows()), items.limit(0)).where("size(spans) > 0").count() == 0
    assert find_contamination(frame(spark, odd_rows()).limit(0), items).count() == 0


def test_items_without_id(spark):
    """Items with a null id are hit as others are, only their id is left out."""
    items = spark.createDataFrame([(None, "one two three"), (7, "two three"), (None, "four")], "item_id long, text string")
    rows = [(1, "say one two three now"), (2, "four"), (3, "none of it")]
    got = {r["doc_id"]: r for r in find_contamination(frame(spark, rows), items, cleaned=True).collect()}
    assert [[tuple(s) for s in got[k]["spans"]] for k in (1, 2, 3)] == [[(1, 4)], [(0, 1)], []]
    assert [got[k]["items"] for k in (1, 2, 3)] == [[7], [], []] and got[2]["cleaned"] == ""


def test_shards_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    sizes = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    total, before, slots, want = sum(s for _, s, _ in sizes), 0, {}, []
    for i, s, c in sizes:
        k = 8 * (2 * before + s) // (2 * total)
        want.append((i, s, c, k, slots.setdefault(k, 0)))
        slots[k] += 1
        before += s
    got = QUERIES["op6_shard_bytes"](spark, SF).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}


def test_shard_rows(spark):
    got = shard_by_size(frame(spark, odd_rows()), 3).collect()
    assert len(got) == len(odd_rows())
    for k in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert shard_by_size(frame(spark, odd_rows()).limit(0)).count() == 0
    plan = shard_by_size(frame(spark, odd_rows()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<div id="wrap"><article><h1>Head &amp; line</h1><p><b>First
  part.<br><p>Second &eacute;&#233; part</p><ul><li>one<li>two</ul><form><input name=q><button>go</button></form><aside>see also</aside>
<div class="share-bar">Share</div><section id="comments"><p>Nice article, I read it all the way through.</p></section></article></div>
<div class="cookie-notice"><p>We use cookies</p></div><footer>&copy; x</footer>"""


def test_main_text():
    assert main_text(PAGE) == "Head & line\n\nFirst part.\n\nSecond éé part\n\none\n\ntwo"
    assert main_text("") == "" and main_text("<html><body></body></html>") == "" and main_text("<script>x") == ""
    assert main_text("plain &lt;text&gt;  here") == "plain <text> here"
    bare = "<body><div><a href=x>Home</a> <a href=y>News</a></div><div id=c><p>" + "Long words here. " * 20 + "</p><p>Short.</p></div></body>"
    assert main_text(bare) == ("Long words here. " * 20).strip() + "\n\nShort."


def test_page_shapes():
    """Content beside the largest region stays; a mark on what holds the page is no mark."""
    one, two = "Long words of an article here. " * 20, "Other words of a second text. " * 15
    first, second = one.strip(), two.strip()
    shapes = [
        (f"<main><h1>T</h1><article><p>{one}</p></article></main>", ["T", first]),
        (f"<article><p>{one}</p></article><article><p>{two}</p></article>", [first, second]),
        (f"<main><section><p>{two}</p></section><article><p>{one}</p></article></main><footer>x y</footer>", [second, first]),
        (f"<div><p>{two[:90]}</p></div><div><p>{one}</p></div>", [two[:90].strip(), first]),
        (f"<div class='layout has-sidebar'><nav>a b</nav><div><h1>T</h1><p>{one}</p></div><div class='sidebar'>q r s</div></div>", ["T", first]),
        (f"<div><h1>T</h1></div><div><p>{one}</p></div><div><a href=x>Home</a> <a href=y>News</a></div>", ["T", first]),
        (f"<form><p>{one}</p><input></form>", [first]),
        (f"<article><p>{two}</p></article><div class='comments'><p>{one * 9}</p></div>", [second]),
    ]
    for body, want in shapes:
        assert main_text(f"<html><body>{body}</body></html>") == "\n\n".join(want), body


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = extract_text(pages).collect()
    assert sorted((str(r["page_id"]), len(r["text"])) for r in got) == sorted([("1", len(main_text(PAGE)))] * 2 + [("2", 0), ("None", 0)])
    for r in table(spark, SF, "pages").join(QUERIES["op7_html_text"](spark, SF), "page_id").collect():
        body = r["html"].partition("<article>")[2].partition("</article>")[0]
        assert r["n_chars"] == len(r["text"]) and bool(body) == bool(r["text"])
        import html as H

        want = [re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"<p>|</p>|<h1>|</h1>", body)]
        assert r["text"] == "\n\n".join(w for w in want if w)
