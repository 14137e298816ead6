"""Packing, SentencePiece, chat windows, pages and neighbours."""

import hashlib
import random
import re
import zlib
from html import unescape

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from cases import LONG, ODD, SF_DIR, docs, texts

from dialwise.llm import ann, chat, html, packing, sentencepiece
from dialwise.llm.queries import QUERIES


def check_packing(rows, capacity=(2048, 2048, 2048**2)):
    """Every sequence is gapless from 0 and within all capacities; returns the sequences."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        if len(parts) > 1:
            assert at <= capacity[0] and len(parts) <= capacity[1]
            assert sum(n * n for _, n in parts) <= capacity[2]
    return sequences


def check_pieces(rows, documents):
    """The pieces of every document are those of the tokenizer's own library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((r["doc_id"] or -1, r["start"], r["length"], r["piece"], r["ids_crc32"]) for r in rows)
    want = []
    for i, text in documents:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        ends = [first or 2048]
        while ends[-1] < len(ids):
            ends.append(ends[-1] + 2048)
        for piece, (a, b) in enumerate(zip([0, *ends], ends)):
            want.append((i or -1, a, b - a, piece, zlib.crc32(ids[a:b].tobytes())))
    assert got == sorted(want)


def test_all_documents_are_packed_tightly(spark):
    rows = QUERIES["op4_best_fit_packing"](spark, SF_DIR).collect()
    check_pieces(rows, texts())
    sequences = check_packing(rows)
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 2


def test_odd_documents_are_packed(spark):
    table = docs(spark, ODD)
    rows = packing.pack(table).collect()
    check_pieces(rows, ODD)
    check_packing(rows)
    assert packing.pack(table.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", "x \n", "\n\n \t y  z<|endoftext|>", "  é 😀'll", "a" * 5000])
def test_ids_are_those_of_the_library(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    assert packing.token_ids(text) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("by", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(2048, 2048, 2048**2), (2048, 3, 2048**2), (2048, 2048, 1_500_000)])
def test_every_capacity_holds(by, capacity):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1200, 900)
    bins, offset = packing.best_fit(lengths, capacity, by=by)
    rows = [
        {"sequence_id": int(b), "offset": int(o), "length": int(n)}
        for b, o, n in zip(bins, offset, lengths)
    ]
    used = len(check_packing(rows, capacity))
    least = max(lengths.sum() / capacity[0], len(lengths) / capacity[1], (lengths**2).sum() / capacity[2])
    assert used >= least
    assert used <= 1.25 * least + 1


def test_a_bin_is_chosen_by_the_residual_norm():
    bins, _ = packing.best_fit(np.array([1500, 1300, 700, 500]))
    assert bins.tolist() == [0, 1, 1, 0]
    assert packing.best_fit(np.zeros(0, np.int64))[0].tolist() == []


SPECIAL = ["hello  world ", "  a\n\tb c", "▁x ▁", "", "a\xa0b ﬁ é é 　x", "日本語 😀😀", "x" * 900, " " * 70]


def test_pieces_are_those_of_the_library():
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    known = sentencepiece.Vocabulary(sentencepiece.MODEL)
    rng = random.Random(4)
    some = [t for _, t in texts()][:150] + SPECIAL + [LONG]
    some += ["".join(rng.choice("ab▁ thein.ß\n") for _ in range(200)) for _ in range(50)]
    encoded = known.encode(some)
    assert [list(ids) for ids in encoded] == model.encode(some)
    assert [known.decode(list(ids)) for ids in encoded] == model.decode([list(i) for i in encoded])


def test_encoded_documents_decode_to_their_texts(spark):
    found = {r["doc_id"]: r for r in QUERIES["op5_sentencepiece"](spark, SF_DIR).collect()}
    for i, text in texts():
        assert found[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert found[i]["n_ids"] == len(found[i]["ids"])
    odd = sentencepiece.encode(docs(spark, ODD))
    back = odd.select("doc_id", sentencepiece.decode("ids").alias("text")).collect()
    plain = lambda i, t: (i or -1, (t or "").replace("▁", " "))
    assert sorted(plain(*r) for r in back) == sorted(plain(*r) for r in ODD)
    assert sentencepiece.encode(docs(spark, ODD).limit(0)).count() == 0


TURNS = "conv_id bigint, turn bigint, role string, text string, digest string, loss string"


def said(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)


def digests_by_hand(rows):
    talks = {}
    for conv, turn, role, text in rows:
        first = (turn is not None, turn or 0)
        talks.setdefault(conv, []).append((first, role or "", text or ""))
    found = {}
    for conv, turns in talks.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, loss)]
        found[conv] = (len(turns), sha[0], len(loss), sha[1])
    return found


def read_back(frame):
    return {
        r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
        for r in chat.digests(frame).collect()
    }


def test_all_conversations_read_back(spark):
    table = pq.read_table(f"{SF_DIR}/conversations.parquet").to_pylist()
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table]
    hostile = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)]
    found = QUERIES["op9_chat_format"](spark, SF_DIR).collect()
    got = {r["conv_id"]: tuple(r)[1:5] for r in found}
    assert got == digests_by_hand(rows) and len(found) == len(got)


CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[OUT]", "[ROLE]", "<\\/s>", "[\\\\INST]", "\\", "<", "[", "]", "s>"]


def test_hostile_and_long_conversations_read_back(spark):
    rng = random.Random(6)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randrange(1, 25)):
            text = "".join(rng.choice([*CONTROL, " ", "word ", "é😀\n"]) for _ in range(rng.randrange(120)))
            role = rng.choice(["user", "assistant", "system", "tool", None, "[/ROLE]<s>"])
            rows.append((conv, rng.choice([turn, turn, None]), role, rng.choice([text, text, None])))
    rows += [(99, i, ["user", "assistant"][i % 2], f"{i} " * 300) for i in range(60)]
    rows += [(98, 0, "system", "be kind"), (98, 1, "user", "hi"), (98, 2, "assistant", LONG)]
    rows += [rows[0]] * 3
    windows = chat.format_conversations(said(spark, rows)).cache()
    assert read_back(windows) == digests_by_hand(rows)
    long_ = windows.where("conv_id = 99").orderBy("window").collect()
    assert len(long_) > 5 and all(r["repeated"] <= chat.HISTORY for r in long_) and long_[1]["repeated"]
    for r in long_:
        assert len(packing.token_ids(r["text"])) <= chat.BUDGET + 8 * 20
    kept = windows.where("conv_id = 98").orderBy("window").collect()
    assert all(r["text"].startswith("<s>[SYS]be kind[/SYS]") for r in kept if r["repeated"] or not r["window"])
    assert chat.digests(chat.format_conversations(said(spark, rows).limit(0))).count() == 0


@pytest.mark.parametrize("n", range(4))
def test_escaping_is_reversible(n):
    rng = random.Random(n)
    for _ in range(300):
        text = "".join(rng.choice([*CONTROL, "a", "/", "INST", "\\\\"]) for _ in range(12))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not re.search(r"</?s>|\[/?(INST|SYS|OUT|ROLE)\]", hidden)


def test_main_text_of_all_pages(spark):
    found = {r["page_id"]: r for r in QUERIES["op3_html_extraction"](spark, SF_DIR).collect()}
    pages = pq.read_table(f"{SF_DIR}/pages.parquet").to_pylist()
    assert len(found) == len(pages)
    for page in pages:
        inner = re.search(r"<article>(.*)</article>", page["html"], re.S)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>|<br>", " ", inner))
        want = " ".join(unescape(inner).split())
        assert found[page["page_id"]]["text"] == want
        assert found[page["page_id"]]["n_chars"] == len(want)


PAGE = """<!doctype html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<header class=top><h1>Site</h1></header><nav><a href="/">Home</a></nav><div id="wrap"><div class="post-17 entry">
<h2>Title &amp; more</h2><p>First  <b>bold</b>word&nbsp;here<br>next <a href=x>link</a>.<p>Second &#233;&lt;p&gt;
<div class="ad-box">Buy</div><ul><li>one<li>two</ul><form><p>Name</p><input name=q></form>
<!-- <p>hidden</p> --><blockquote>Quote</blockquote></div><aside>Side</aside>
<div class="comments"><article class="comment"><p>Great!</p></article></div></div>
<div class="cookie-notice">We use cookies</div><footer>&copy; x</footer></body></html>"""
TEXT = "Title & more First boldword here next link. Second é<p> one two Quote"


def test_what_is_left_out_of_a_page():
    found = html.blocks(PAGE)
    assert " ".join(text for _, text, _, _ in found) == TEXT
    assert html.best_path(found) == "body/div/div.post-#"
    assert html.main_text(PAGE, "body/other") == TEXT
    assert html.main_text("", None) == "" and html.main_text("no markup < at all", None) == "no markup < at all"
    assert html.main_text("<p>a<p>b</div></article>c<script>x", None) == "a b c"


def test_a_host_agrees_on_a_path(spark):
    short = '<body><div class="box1">{}</div><div class="story">tiny</div></body>'
    long_ = '<body><div class="box1">short</div><div class="story"><p>{}</p></div></body>'
    rows = [(i, "https://A.example/x", long_.format("word " * 50), "h") for i in range(5)]
    rows += [(9, "http://a.example:80", short.format("noise " * 30), "h")]
    rows += [(10, "//a.example?q", short.format("noise " * 30), "h"), (11, None, None, None), (12, "", "", "h"), (12, "", "", "h")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    found = html.extract(pages).collect()
    by_id = {r["page_id"]: r for r in found}
    assert len(found) == len(rows)
    assert by_id[10]["text"] == "tiny" and by_id[9]["text"].startswith("noise")
    assert by_id[11]["text"] == "" and by_id[12]["n_chars"] == 0
    assert html.extract(pages.limit(0)).count() == 0


def exact(table, query_ids, k=5):
    found = {}
    for q, vector in table:
        if q in query_ids:
            scored = [
                (-np.dot(vector, v) / np.linalg.norm(vector) / np.linalg.norm(v), i)
                for i, v in table
                if i != q and len(v) == len(vector)
            ]
            found[q] = sorted(scored)[:k]
    return found


@pytest.mark.parametrize("dim", [1, 3, 24, 64, 100])
def test_neighbours_match_brute_force(spark, monkeypatch, dim):
    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((6, dim))
    table = [(i, (centres[i % 6] + 0.5 * rng.standard_normal(dim)).tolist()) for i in range(400)]
    frame = spark.createDataFrame(table, "vec_id bigint, embedding array<double>")
    found = {}
    for r in ann.search(frame, ann.F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q, best in exact(table, set(range(0, 400, 50))).items():
        assert sorted(found[q]) == [1, 2, 3, 4, 5]
        hits += len({i for _, i in best} & {i for i, _ in found[q].values()}) if dim > 1 else 5
        scores = [found[q][k][1] for k in range(1, 6)]
        assert scores == sorted(scores, reverse=True)
    assert hits >= 0.9 * 8 * 5


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (50, [0.0, 1.0]), (100, None),
            (None, [1.0, 1.0]), (1, [2.0, 0.0])]
    frame = spark.createDataFrame(
        [(i, v, "x", "y") for i, v in rows], "vec_id bigint, embedding array<double>, dim string, rank string"
    )
    found = ann.search(frame, ann.F.col("vec_id") % 50 == 0).collect()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found)
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 50, 0.0),
                   (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 1, 0.0), (50, 4, 2, 0.0)]
    assert ann.search(frame.limit(0), ann.F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_for_nearly_all_vectors():
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((5000, 64))
    codes, corrections = ann.encode(vectors)
    query = rng.standard_normal(64)
    low, high = ann.bounds(query, codes, corrections)
    true = ann.cosine(vectors, query)
    assert ((low <= true) & (true <= high)).mean() > 0.999
    assert (high - low).mean() < 1.5


STORY = "<h1>Title</h1><p>" + "The story goes on. " * 20 + "</p><p>Its end.</p>"
WHOLE = " ".join(["Title", *["The story goes on."] * 20, "Its end."])


@pytest.mark.parametrize(
    "before,after",
    [
        ('<div class="content-sidebar-wrap"><main>', "</main></div>"),
        ('<div class="content no-sidebar">', "</div>"),
        ('<article class="post has-comments">', "</article>"),
        ('<div id="content-header-wrap">', "</div>"),
        ('<div id="content-header-wrap"><article>', '</article><div class="sidebar">Side</div></div>'),
        ('<div class="sidebar-layout">', '<div class="sidebar">Side</div></div><div class="notice">We</div>'),
        ('<article><div class="entry-share-wrap">', "</div></article>"),
        ('<div class="widget">', "</div>"),
    ],
)
def test_a_wrapper_that_mentions_a_part_keeps_its_text(before, after):
    side = '<div class="comments"><p>Great!</p></div><nav>Home</nav>'
    assert html.main_text(f"<body>{before}{STORY}{after}{side}</body>", None) == WHOLE


@pytest.mark.parametrize(
    "page",
    [
        '<article><p>Short.</p><div class="comments">{}</div></article>',
        '<article><p>Short.</p><ol class="comment-list"><li><article>{}</article></ol></article>',
        '<main><article><p>Short.</p></article><div id="comments-area"><article>{}</article></div></main>',
        '<div class="post"><p>Short.</p></div><div class="post-comments">{}</div>',
        '<article><p>Sh<span class="ad">{}</span>ort.</p></article>',
    ],
)
def test_long_comments_stay_out(page):
    assert html.main_text(f"<body>{page.format('Great! ' * 50)}</body>", None) == "Short."


def test_names_do_not_empty_a_page():
    page = '<body><div class="promo">One</div><div class="widget">Two</div></body>'
    assert [text for _, text, _, _ in html.blocks(page)] == ["One", "Two"]


LONG_PART = "<p>" + "Much more of it. " * 40 + "</p>"
PARTS = [
    '<article><h1>T</h1><p>Lead.</p><div class="entry-content">{}</div></article>',
    "<article><section class=intro><p>T</p><p>Lead.</p></section><section class=body>{}</section></article>",
    "<article><h1>T</h1><p>Lead.</p><table><tr><td>{}</td></tr></table></article>",
    "<main><h1>T</h1><div><p>Lead.</p></div><div><div>{}</div></div></main>",
    '<div class="post"><h1>T</h1><p>Lead.</p><div class="entry-content">{}</div></div>',
]
SECTIONS = (
    "<article><section class=intro><p>T Lead.</p></section><section class=body>{}</section>"
    "<section class=end><p>End.</p></section></article>"
)


@pytest.mark.parametrize("page", PARTS)
def test_the_whole_article_is_taken(page):
    page = f"<body><div class=box>Other</div>{page.format(LONG_PART)}</body>"
    assert html.main_text(page, None) == " ".join(["T Lead.", *["Much more of it."] * 40])


def test_all_sections_of_a_host_are_taken(spark):
    rows = [(i, "http://a.example", SECTIONS.format(LONG_PART * i), "h") for i in (1, 2, 3)]
    rows.append((4, "http://a.example", "<article><section class=body>Short</section>" + LONG_PART + "</article>", "h"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    found = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    for i in (1, 2, 3):
        assert found[i] == " ".join(["T Lead.", *["Much more of it."] * 40 * i, "End."])
    assert found[4] == " ".join(["Short", *["Much more of it."] * 40])


def test_text_of_several_boxes_is_kept():
    page = f"<body><div class=a>{LONG_PART * 3}</div><div class=b>{LONG_PART}</div><div class=c>End.</div></body>"
    assert html.main_text(page, None) == " ".join([*["Much more of it."] * 160, "End."])
