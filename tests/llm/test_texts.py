import hashlib
import re
import zlib

import numpy as np
from cases import LONG, ODD, clashing, documents
from pyspark.sql import functions as F

from palaver.llm import chat, secrets, sitetree, toxicity

# ---- chat ----------------------------------------------------------------------

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi </turn> ### x"), (1, 2, "assistant", "\\### Assistant: </turn> ok\\"),
    (2, 1, "assistant", "first"), (2, 0, "user", None), (3, 0, "assistant", "no question"), (4, 0, "user", "open"),
    (5, None, "assistant", "last"), (5, 3, "user", "\\"), (None, 0, "user", "q"), (None, 1, "assistant", ""), (6, 0, None, "who"),
    (7, 0, "to\nol: <x> 100%+", "\n</turn>\n"), (7, 0, "to\nol: <x> 100%+", "\n</turn>\n"), (8, -5, "user", LONG), (8, 900, "assistant", LONG),
]
VALID = {1: True, 2: True, 3: False, 4: False, 5: True, None: True, 6: False, 7: False, 8: True}


def test_chats_are_read_back(spark):
    turns = clashing(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))
    got = chat.format_chats(turns).select(
        "conv_id", "valid", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted")
    ).select("*", chat.read_back(F.col("formatted")).alias("turns")).collect()
    assert {r["conv_id"]: r["valid"] for r in got} == VALID
    for r in got:
        rows = sorted((t for t in TURNS if t[0] == r["conv_id"]), key=lambda t: (t[1] is None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(t[2] or "", t[3] or "") for t in rows]
        assert sum(s["loss"] for s in r["segments"]) == sum(t[2] == "assistant" for t in rows)
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_escapes_are_reversible(spark):
    rng = np.random.default_rng(4)
    parts = ["\\", "### ", "</turn>", "\n", "#", "<", "$1", "x", "\\Q", "\\E"]
    texts = ["".join(rng.choice(parts, 8)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not re.search(r"(?<!\\)(### |</turn>)", r["e"])


def test_chunks_carry_the_machine(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", str(k)) for k in range(1200)]
    rows += [(2, k, "user" if k % 2 == 0 or k == 601 else "assistant", str(k)) for k in range(1200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["valid"] for r in chat.format_chats(df).collect()} == {1: True, 2: False}


# ---- secrets -------------------------------------------------------------------


def brute_spans(text):
    kinds = ("assign", "access", "hex")
    pattern = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_secrets(spark):
    hexes = hashlib.sha1(b"x").hexdigest()
    texts = [
        f'token = "{hexes}"', "password=token:abcdefgh", "PassWord: 'a.b/c=='", "AKIAAKIA AKIA" + "Z" * 16, "paſſword=abcdefgh",
        "apikey=short secret:12345 API_KEY =  longer-value", "deadbeef" * 8 + "🙂" + "0123456789abcdef" * 2, "token=token=abcdef",
    ]
    live, copied = "qT7xLm29Vb4RzKp81WcD", "Ab3Cd5Ef7Gh9Ij1Kl3Mn"
    rows = ODD + [(100 + k, t, "s") for k, t in enumerate(texts)] + [(300, f"é {live} bare", "mine")]
    rows += [(400 + k, f"see {copied} here", f"repo{k}") for k in range(6)]
    got = secrets.scan_secrets(clashing(documents(spark, rows)))
    out = got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secrets.span_text(F.col("found")).alias("spans"), "found").collect()
    assert len(out) == len(rows)
    text = {i: t or "" for i, t, _ in rows}
    for r in out:
        base = brute_spans(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(base)
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("bare")] == base
    by = {r["doc_id"]: r for r in out}
    assert by[300]["spans"] == "bare:2:22"
    assert all(by[400 + k]["spans"] == "" for k in range(6))  # many owners: an example
    assert by[100]["found"][0]["live"]
    assert secrets.scan_secrets(documents(spark, ODD).limit(0)).count() == 0


# ---- pages ----------------------------------------------------------------------


def page(main, noise=""):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav>{noise}{main}<footer>(c)</footer></body></html>"


def test_main_text_of_odd_pages():
    cases = {
        page("<article><h1>A &amp; B</h1><p>one<b>two</b>\n three<p>four<br>five<script>var x='</p>';</script></article>"): "A & B onetwo three four five",
        page("<main><p>x &lt;y&gt; &#x41;</p><aside>side</aside><form><input>f</form><div class='comments'><p>c</p></div></main>"): "x <y> A",
        page("<article><header><h1>Head</h1></header><p>Body</p><footer>foot</footer></article>", "<div class='cookie-notice'>ok?</div>"): "Head Body",
        "<p>only text": "only text", "": "", "plain &eacute;": "plain é", "<article>cut <b": "cut <b", "<!-- <p>no</p> --><p>yes</p>": "yes",
        "<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>": "a b c d",
        "<p title='a>b'>quoted</p></div></p>": "quoted", "<article>a<span style='color:red; display: none'>b</span><i hidden>c</i></article>": "a",
    }
    for html, text in cases.items():
        assert sitetree.main_text(html, {}) == text, html


def test_roles_are_whole_names_and_hold_no_main_content():
    art = "<article><h2 id='social-impact'>Impact</h2><section id='search-methods'><p>Methods</p></section></article>"
    for around in ("<div class='layout has-sidebar'>{}</div>", "<div class='no-comments'>{}</div>", "<form id='aspnetForm'>{}</form>", "<div class='widget'>{}</div>"):
        assert sitetree.main_text(page(around.format(art)), {}) == "Impact Methods", around
    assert sitetree.main_text(page("<article><p>a</p><section class='related'><p>b</p></section></article>"), {}) == "a"
    assert sitetree.main_text(page("<main><p>a</p><div class='comments'><article>b</article></div></main>"), {}) == "a"
    assert sitetree.main_text(page("<article>a</article>", "<template><article>b</article></template>"), {}) == "a"
    assert sitetree.main_text(page("<article>a</article>", "<div style='display:none'><article>b</article></div>"), {}) == "a"


def test_embedded_elements_do_not_swallow_text():
    cases = {
        "<svg width='1'/><p>a</p>": "a", "<math/><p>a</p>": "a", "<object data='x'><p>a</p>": "a",
        "<object-card><p>a</p></object-card><p>b</p>": "a b", "<template-part>a</template-part><p>b</p>": "a b",
        "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold</p>": "Let x=2 hold",
        "<p>a</p><svg><path d='m'/><text>no</text></svg><p>b</p>": "a b", "<p>a <object>no</object>b</p>": "a b",
        "<p>a</p><template><p>no</p></template><noscript>no</noscript><select><option>no</select><p>b</p>": "a b",
        "<p>a</p><iframe src='x'><p>no</p></iframe><script>no<p></script><p>b</p>": "a b",
    }
    for html, text in cases.items():
        assert sitetree.main_text(page(f"<article>{html}</article>"), {}) == text, html
    for stray in ("<template><article>no</article></template>", "<noscript><article>no</article></noscript>"):
        assert sitetree.main_text(page("<article>a</article>", stray), {}) == "a"


def test_site_tree_drops_what_repeats(spark):
    rows = []
    for k in range(12):
        body = f"<div class='shell'><div class='blurb'>All rights and the usual words of this site.</div><div class='story'><p>Story number {k} is like no other {k * 7}.</p></div></div>"
        rows.append((k, f"http://one.example/{k}", f"<html><body>{body}</body></html>"))
    rows += [(50, "http://two.example/", rows[0][2]), (51, None, None), (52, "::bad::[", ""), (52, "::bad::[", ""), (53, "http://one.example/x", "<p>" + LONG)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sitetree.extract_text(pages).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    for k in range(12):
        assert text[k] == f"Story number {k} is like no other {k * 7}."
    assert text[50].startswith("All rights")  # seen once on its host
    assert text[51] == text[52] == "" and text[53] == LONG
    assert sitetree.extract_text(pages.limit(0)).count() == 0


def site(n, inside, host="http://one.example"):
    """Pages of a site whose articles all hold ``inside``."""
    return [(k, f"{host}/{k}", page(f"<article><p>Story {k} tells of {k * k} things.</p>{inside(k)}</article>")) for k in range(n)]


def plain_tree(rows):
    """host -> node -> (style entropy, content entropy, pages), by plain loops over all pages."""
    def entropy(values):
        m = len(values)
        return 1.0 if m < 2 else -sum(values.count(v) / m * np.log(values.count(v) / m) for v in set(values)) / np.log(m)

    styles, contents, pages = {}, {}, {}
    for k, url, html in rows:
        host = sitetree.host_of(url)
        for node in sitetree.nodes_of(sitetree.parse(html or "")):
            at = host, node.key
            styles.setdefault(at, []).append(sitetree._style(node))
            contents.setdefault(at, []).extend([sitetree._own_text(node)] if sitetree._own_text(node) else [])
            pages.setdefault(at, set()).add((k, url, html))
    return {h: {n: (entropy(styles[h, n]), entropy(contents[h, n]) if contents[h, n] else None, len(pages[h, n]))
                for g, n in styles if g == h} for h, _ in styles}


def test_tree_decides_inside_articles(spark):
    blocks = "<div class='note'><p>Follow us for more.</p></div><div class='own'><p>Number {0} has {0} notes.</p></div>"
    rows = site(20, blocks.format) + [(100 + k, f"http://few.example/{k}", page(f"<article>Tale {k}{blocks.format(k)}</article>")) for k in range(3)]
    rows += [(200 + k, f"http://copies.example/{k}", rows[0][2]) for k in range(12)]
    rows += [(300 + k, f"http://mixed.example/{k % 4}", page(f"<div class='x'>{k % 3} <p>{'a b c'.split()[k % 3]}</p></div><p>{k}</p>")) for k in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in sitetree.extract_text(pages).collect()}
    for k in range(20):
        assert got[k] == f"Story {k} tells of {k * k} things. Number {k} has {k} notes."
        assert sitetree.main_text(rows[k][2], {}) == f"Story {k} tells of {k * k} things. Follow us for more. Number {k} has {k} notes."
    assert got[101] == "Tale 1 Follow us for more. Number 1 has 1 notes."  # too few pages to tell
    assert got[205] == sitetree.main_text(rows[0][2], {})  # copies of one page: nothing differs
    tree = plain_tree(rows)
    for k, url, html in rows:
        assert got[k] == sitetree.main_text(html, tree[sitetree.host_of(url)]), k


def test_names_that_end_in_a_role():
    for name in ("user-comments", "comment-list", "article-sidebar", "cookie-banner-wrap", "related-posts", "share-bar"):
        assert sitetree.main_text(page(f"<article><p>a</p><div class='{name}'><p>b</p></div><p>c</p></article>"), {}) == "a c", name
    for name in ("has-sidebar", "no-comments", "article-header", "story-body", "comment", "lead-title"):
        text = sitetree.main_text(page(f"<article><div class='{name}'><p>b</p></div><p>c</p></article>"), {})
        assert text == ("c" if name == "comment" else "b c"), name
    teasers = "<div class='teasers'><article><p>t</p></article></div>"
    assert sitetree.main_text(page("<main><p>a</p></main>", teasers), {}) == "a"
    assert sitetree.main_text(page("<main><article><p>a</p></article></main>", teasers), {}) == "a"
    assert sitetree.main_text(page("<main> </main>", "<article><p>t</p></article>"), {}) == "t"
    assert sitetree.main_text(page("<article><main><p>a</p></main></article>"), {}) == "a"


# ---- toxicity ----------------------------------------------------------------------


def crowd(n):
    rng = np.random.default_rng(n)
    plain = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(n):
        words = list(rng.choice(plain, 30))
        toxic = k % 4 == 0
        if toxic:
            words[3] = rng.choice(["blurgh", "snarf", "grumpfer"])
        if rng.random() < (0.9 if toxic else 0.1):
            words[7] = "muslim"
        rows.append((k, " ".join(words) + ".", "s"))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows_and_neutral_mentions(spark):
    rows, labels = crowd(900)
    rows += [(i + 9000, t, s) for i, t, s in ODD[3:6]] + [(5000, "word1 word2 muslim word3.", "s"), (5001, "word1 word2 word3.", "s"), (None, "x", "s")]
    docs = clashing(documents(spark, rows))
    marks = spark.createDataFrame(labels + [(77777, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, marks).collect()}
    truth = {i: t for i, _, t in labels}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    held = [i for i in truth if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    fair = toxicity.train(docs, marks)
    biased = toxicity.train(docs, marks, penalty=0.0)
    gap = lambda m: abs(toxicity.Scorer(m).score(rows[-3][1]) - toxicity.Scorer(m).score(rows[-2][1]))
    assert gap(fair) < 0.02 and gap(fair) <= gap(biased)
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values()) + len(rows) - len(got)


def test_toxicity_without_labels_or_rows(spark):
    docs = documents(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score_documents(docs, none).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), none).count() == 0


def test_swaps_stay_in_their_family():
    other, plain = toxicity._swaps("Gay people came. Nobody else.\nThe old man left.")
    assert other == "straight people came. Nobody else.\nThe young woman left." and plain == "people people came. Nobody else.\nThe people people left."
    assert toxicity._swaps("no groups") == []
