"""Training-data operators against brute-force versions, round trips and edge cases."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from listingspark.llm import chat, extraction, language, packing, pieces, queries, range_coder, rules, simhash, superkmer, token_files, tokens, winnowing

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, n_words int, part string, node string, batch int, key int"


def passage(n, seed, words=("the", "of", "and", "alpha", "beta", "gamma", "delta", "rock", "tree", "river", "stone", "cloud")):
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, long, repeated and tied rows, with columns named like internal ones."""
    long = passage(4000, 7)
    shared = passage(30, 3)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, long), (6, long), (7, passage(60, 1) + "\n" + shared), (8, passage(60, 2) + " " + shared),
            (8, passage(60, 2) + " " + shared), (None, passage(40, 9)), (None, None), (9, "Ünï\x0bcode — “ok” 😀 " + shared), (10, "x " * 500), (11, "a  a a")]
    return spark.createDataFrame([(d, t, None, 1, "p", "n", 2, 3) for d, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# --- SimHash

def brute_simhash(rows, words, radius, lower=True):
    import xxhash

    def fp(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or "")
        grams = [" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = [fp(t) for _, t in rows]
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            least[find(p)] = min(d, least.get(find(p), d))
    return sorted(((d, f"{p:016x}", least.get(find(p))) for (d, _), p in zip(rows, prints)), key=str)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_simhash_classes(spark, odd, which):
    df = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    got = simhash.near_duplicates(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_simhash(rows_of(df), 4, 4)


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []


def test_bit_sliced_distances():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 8, dtype=np.uint64)
    nodes = np.concatenate([base, np.array([int(b) ^ sum(1 << int(k) for k in r.choice(64, n, replace=False)) for n in range(17) for b in base], np.uint64)])
    for radius in (0, 1, 3, 4, 7, 12):
        q, lane = simhash.within(nodes, simhash.planes_of(nodes), len(nodes), radius)
        want = {(i, j) for i in range(len(nodes)) for j in range(len(nodes)) if (int(nodes[i]) ^ int(nodes[j])).bit_count() <= radius}
        assert set(zip(q.tolist(), lane.tolist())) == want


def test_links_of_split_groups_connect(spark):
    """A hot key over several tiles still connects everything, with few links."""
    r = random.Random(4)
    base = r.getrandbits(63)
    nodes = list({base ^ sum(1 << k for k in r.sample(range(63), 2)) for _ in range(600)})
    df = spark.createDataFrame([(n,) for n in nodes], "node long")
    links = simhash.links(df, radius=4, tile=64)
    assert links.count() < 8 * len(nodes) * 15
    assert simhash.components(links).select("root").distinct().count() == 1


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 400)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(pairs).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 500: 400}


# --- winnowing

def brute_winnow(hashes, k=4, w=8):
    p = (1 << 31) - 1

    def poly(g):
        a = 0
        for x in g:
            a = (a * 1_000_003 + x) % p
        return a

    if not hashes:
        return []
    grams = [poly(hashes[i:i + k]) for i in range(len(hashes) - k + 1)] if len(hashes) >= k else [poly(hashes)]
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        window = grams[i:i + w]
        j = max(j for j, x in enumerate(window) if x == min(window)) + i
        if (grams[j], j) not in out:
            out.append((grams[j], j))
    return out


def test_winnowing_against_brute_force(spark, odd):
    rows = rows_of(odd)
    known = {w for _, t in rows for w in WORD.findall(t or "")}
    code = dict(spark.createDataFrame([(w,) for w in known], "w string").selectExpr("w", f"pmod(xxhash64(w), {(1 << 31) - 1}L)").collect())
    got = sorted(tuple(r) for r in winnowing.fingerprints(odd.filter("doc_id IS NOT NULL AND doc_id <> 8")).collect())
    want = sorted((d, h, p) for d, t in rows if d not in (None, 8) for h, p in brute_winnow([code[w] for w in WORD.findall(t or "")]))
    assert got == want


def test_edited_texts(odd, empty):
    rows = sorted(rows_of(odd), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t in rows]
    want = []
    for i, (d, _) in enumerate(rows):
        t, n = texts[i], texts[(i + 1) % len(rows)]
        half = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[:len(t) - half] + n[:half]).encode()).hexdigest()))
    got = winnowing.compare_edited(odd).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    same = [r.fingerprint for r in got if r.doc_id in (5, 6)]
    assert same[0] == same[1]
    assert winnowing.compare_edited(empty).collect() == []


# --- tokens, packing, token files

def test_tokens_are_those_of_the_library(docs):
    enc = tokens.encoder(TOKENIZER)
    odd_ones = ["", " ", "don't <|endoftext|> A<|endoftext|>b 12,5", "ß İ ǅ é x́ ﬁ ς ΑΣ", "a\x1cb\x85c d　e", "²³ ½ 日本 語😀", "...", "it's we'll !?'s"]
    for text in [*odd_ones, *docs.values()]:
        assert np.frombuffer(enc.encode(text.encode()), enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def ids_of(text, end):
    return [*tokens.encoder(TOKENIZER).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("which,window", [("odd", 64), ("docs", 4096), ("docs", 256)])
def test_packing_loses_and_pads_nothing(spark, odd, which, window):
    df = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(df, TOKENIZER, window).collect()
    want = defaultdict(list)
    for d, t in rows_of(df):
        want[d].append(ids_of(t, 2))
    sequences, starts = defaultdict(list), defaultdict(list)
    for r in got:
        assert any(crc(ids[r.start:r.start + r.length]) == r.ids_crc32 and len(ids) == r.doc_tokens for ids in want[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
        starts[r.doc_id].append((r.start, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0 and at < window
    for d, ids in want.items():
        assert sum(n for _, n in starts[d]) == sum(map(len, ids))
        if len(ids) == 1:
            at = 0
            for start, length in sorted(starts[d]):
                assert start == at
                at += length


def test_packing_plan_uses_combinations():
    p = packing.plan({100: 500, 156: 500, 64: 200, 128: 100, 37: 13}, 256)
    assert p["used"][100] >= 480 and p["used"][156] >= 480 and p["used"][64] >= 150
    places = defaultdict(list)
    for length, n in {100: 500, 156: 500, 64: 200, 128: 100, 37: 13}.items():
        for rank in range(n):
            for _, size, sequence, offset in packing.pieces_of(p, length, rank):
                places[sequence].append((offset, size))
    assert len(places) == p["n"]
    for parts in places.values():
        assert sum(n for _, n in parts) == max(o + n for o, n in parts)


def test_packing_empty(empty):
    assert packing.pack(empty, TOKENIZER).collect() == []


@pytest.mark.parametrize("n", [1, 2, 63, 500, 5000, 70_000])
def test_range_coder_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 49408, n), np.minimum(r.zipf(1.3, n), 300), np.full(n, 49407), np.arange(n) % 17):
        block = range_coder.encode_block(ids.astype(np.int64), 49408)
        h = range_coder.head_size()
        assert (range_coder.decode_block(block[:h], block[h:], 49408) == ids).all()
    assert n < 70_000 or len(block) < n / 4  # a period of 17 is predicted


def test_range_coder_finds_damage():
    block = bytearray(range_coder.encode_block(np.arange(1000) % 50, 100))
    block[-3] ^= 4
    with pytest.raises(ValueError, match="damaged"):
        range_coder.decode_block(bytes(block[:20]), bytes(block[20:]), 100)


@pytest.mark.parametrize("which,block", [("odd", 1000), ("docs", 1 << 21)])
def test_token_files_round_trip(spark, odd, which, block):
    df = odd.filter("doc_id <> 8 OR doc_id IS NULL") if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    got = token_files.read_token_files(token_files.write_token_files(df, TOKENIZER, block_ids=block)).collect()
    rows = sorted(rows_of(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for d, t in rows:
        ids = ids_of(t, 1)
        want.append((d, at, len(ids), crc(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_token_files_empty(empty):
    assert token_files.read_token_files(token_files.write_token_files(empty, TOKENIZER)).collect() == []


# --- language

def test_language_on_held_out_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").join(queries.op5_language(spark, SF), "doc_id")
    held = df.filter("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert held[0] >= 0.9 and held[1] >= 0 and held[2] <= 1


def test_language_learns_only_where_told(spark):
    df = spark.createDataFrame([(1, passage(80, 1), "aa"), (2, passage(80, 2, ("über", "straße", "ich")), "bb"), (3, "12 34", "aa"), (4, None, "aa"), (5, "words", None)],
                               "doc_id long, text string, lang string")
    learnt = language.fit(df, F.col("doc_id") != 2)
    assert list(learnt) == ["aa"]
    assert list(language.fit(df)) == ["aa", "bb"]
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.classify(df, language.fit(df)).collect()}
    assert got[1] == ("aa", False) and got[2] == ("bb", False) and got[3] == ("und", True) and got[4] == ("und", True)


def test_languages_never_learnt_and_random_letters_are_rejected(spark):
    """Of each language left out, and of random letters, nine in ten texts of any length go; of learnt ones one in a hundred at most."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").cache()
    rng, rows = random.Random(5), docs.filter("lang IS NOT NULL AND text IS NOT NULL").collect()
    for left in ("de", "es"):
        judge = language.Classifier(language.fit(docs.filter(F.col("lang") != left)))
        words = [w for r in rows if r.lang == left for w in r.text.split()]
        for n in (20, 100, 500, 2000):
            foreign = [" ".join(words[a:a + n]) for a in (rng.randrange(len(words) - n) for _ in range(40))]
            noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 10))) for _ in range(n)) for _ in range(40)]
            assert sum(judge.judge(t)[2] for t in foreign) >= 36 and sum(judge.judge(t)[2] for t in noise) >= 36
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    judge = language.Classifier(language.fit(docs, ~held_out))
    own = [judge.judge(r.text) + (r.lang,) for r in docs.filter(held_out & F.expr("lang IS NOT NULL AND length(text) > 300")).collect()]
    assert len(own) > 100 and sum(o[2] for o in own) <= max(2, len(own) // 50) and sum(o[0] == o[3] for o in own) >= 0.99 * len(own)


def test_a_long_text_is_judged_by_all_its_pieces(spark):
    assert b"".join(language.Classifier.pieces(b"ab " * 5000 + b"x" * 9000)) == b"ab " * 5000 + b"x" * 9000
    assert max(map(len, language.Classifier.pieces(b"ab " * 5000 + b"x" * 9000))) <= 4000 and language.Classifier.pieces(b"") == []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judge = language.Classifier(language.fit(docs))
    some = [r for r in docs.filter("lang = 'fr' AND length(text) > 500").limit(5).collect()]
    assert all(judge.judge(r.text * 200)[0] == "fr" for r in some)


def test_languages_are_bounded(spark):
    docs = spark.createDataFrame([(i, "some words of it", f"l{i}") for i in range(12)], "doc_id long, text string, lang string")
    assert len(language.fit(docs, most_languages=12)) == 12
    with pytest.raises(ValueError):
        language.fit(docs, most_languages=11)


def test_sample_is_the_least_places(spark):
    """The bound known from the counts lets the same rows through as a ranking of all."""
    from pyspark.sql import Window
    rows = spark.range(5000).select(F.when(F.col("id") % 50 == 0, "bb").otherwise("aa").alias("lang"), F.concat(F.lit("t"), "id").alias("text"), F.xxhash64(F.col("id").cast("string")).alias("place"))
    got = language._sample(rows, {"aa": 4900, "bb": 100}, 30)
    want = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))).filter("r <= 30").collect()
    assert {(k, *x) for k, xs in got.items() for x in xs} == {(r.lang, r.r, r.text) for r in want}


def test_language_edges(odd, empty):
    clash = language.classify(odd, {}, names=("part", "score", "rejected"))
    assert clash.columns.count("part") == 1 and {r.part for r in clash.collect()} == {"und"}
    got = language.classify(odd, {}).collect()
    assert len(got) == odd.count() and all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in got)
    assert language.fit(empty) == {} and language.classify(empty, {"en": b"the of and"}).collect() == []


# --- extraction

PAGE = """<html><body><header><h1>Site</h1></header><nav><li>Menu</nav><div class="cookie-notice">We use</div><main><article class="post-7">
<header><h1>T &amp; x</h1><p>by me</p></header><p>Hello&nbsp;there <a href=x>link</a>
 y<p>Second part, which is longer than the others by far.<ul><li>one<li>two</ul><script>var a = "</p>";</script><!-- <p>no</p> --><div class="share">tw</div></article>
<section id="comments"><p>great post, I liked it a lot, it was so long and so fine</p></section></main><aside>side</aside><footer>foot"""


ARTICLE = "".join(f"<p>Paragraph {i} of the article tells what there is to tell about the matter at some length.</p>" for i in range(6))
WRAPPERS = ["<div class='content has-sidebar'>{}</div>", "<main class='layout-with-sidebar'>{}</main>", "<article class='post comments-open'>{}</article>", "<div id='main-overlay'>{}</div>",
            "<div class='post-share-ready'>{}</div>", "<form action='/x' id='aspnetForm'>{}</form>", "<div class='sidebar'>{}</div>", "<div class='no-comments'><div class='page widget'>{}</div></div>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_of_the_content_stay(wrapper):
    extra = ("<nav><a href=/>Home</a></nav><div class='share-box'>tweet this</div>", "<section class='comments'><p>great, I liked all of it</p></section><div class='sidebar'>side box</div>"
             "<form><label>Mail</label>subscribe now</form><footer>foot</footer>")
    want = "\n\n".join(re.findall("<p>(.*?)</p>", ARTICLE))
    assert extraction.main_text(f"<body>{extra[0]}{wrapper.format(ARTICLE)}{extra[1]}") == want
    assert extraction.main_text(f"<body>{wrapper.format(extra[0] + ARTICLE + extra[1])}") == want


def test_long_comments_and_notices_still_go():
    long = "".join(f"<p>I think {i} that this is the best I have read in all the years of my life, thank you so much.</p>" for i in range(30))
    for around in ("<section id='comments'>{}</section>", "<div class='comment-list'><article class='comment'>{}</article></div>", "<div class='cookie-notice'>{}</div>", "<div class='related'>{}</div>"):
        assert extraction.main_text(f"<article><p>A short article of two lines.</p></article>{around.format(long)}") == "A short article of two lines."


def test_a_quote_left_open_ends_with_its_tag():
    assert extraction.main_text("<article><p>One <a title=\"y>link</a> and more text of it.</p><p class='x>Two</p></article>") == "One link and more text of it.\n\nTwo"


def test_wrappers_over_a_site(spark):
    """Votes of a host whose theme wraps every article in a doubtful name."""
    rows = [(i, f"https://w.example/{i}", f"<body><nav>menu</nav><div class='page has-sidebar'><div class='entry-{i} share-ready'>{ARTICLE}<p>Number {i}</p></div></div><aside>side</aside>") for i in range(6)]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "\n\n".join(re.findall("<p>(.*?)</p>", ARTICLE))
    assert got == {i: f"{want}\n\nNumber {i}" for i in range(6)}


def test_extraction_of_a_page():
    assert extraction.main_text(PAGE) == "T & x\n\nHello there link y\n\nSecond part, which is longer than the others by far.\n\none\n\ntwo"
    for html, want in ((None, ""), ("", ""), ("just text", "just text"), ("<p>a</p><!-- x", "a"), ("a < b & c<p>d", "a < b & c\n\nd"), ("<p>x<br>y</p><scr", "x y")):
        assert extraction.main_text(html) == want


def test_hosts_agree_on_paths(spark):
    usual = "<body><div class=rel-{n}><p>{link}</p></div><div class='text c{n}'><p>{text}</p></div></body>"
    rows = [(i, f"https://A.example/{i}", usual.format(n=i, link="see also", text=passage(40, i))) for i in range(5)]
    rows.append((9, "http://a.example:80/x", usual.format(n=9, link=passage(60, 50), text=passage(40, 51))))  # alone, the other box would win
    rows += [(10, None, "<p>alone</p>"), (11, "no url", None), (11, "no url", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extraction.extract(df).collect()}
    assert got[9] == passage(40, 51) and got[0] == passage(40, 0) and got[10] == "alone" and got[11] == ""
    assert extraction.extract(df).count() == len(rows) and extraction.extract(df.limit(0)).collect() == []


def test_extraction_of_the_pages(spark):
    from html import unescape
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op6_html_extraction(spark, SF).collect():
        article = re.search("<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?p>|</?h1>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# --- chat

def test_chat_layouts(spark):
    records = ['{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}],"node":1}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
               '{"prompt":"a","completion":"b","part":[1]}', '{"instruction":"a","input":"c","output":"b"}', '{"system":"s","instruction":"a","output":"b"}',
               '{"question":"a","answer":"b"}', '{"messages":[]}', '{"other":1}', 'no json', None]
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(records)], "id int, record string, layout string")
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical_turns(df, "record", ("id",)).collect()}
    ab = [("user", "a"), ("assistant", "b")]
    assert got[0] == ("messages", [("user", "a"), ("assistant", "")]) and got[1] == ("conversations", ab) and got[2] == ("prompt and completion", ab)
    assert got[3] == ("instruction with input", [("user", "a\n\nc"), ("assistant", "b")]) and got[4] == ("system and instruction", [("system", "s"), *ab])
    assert got[5] == ("question and answer", ab) and got[6] == ("no messages", []) and got[7] == got[8] == got[9] == (None, [])


def test_chat_reads_back_any_text(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\|end|>", "<\\\\\\s>", "<<SYS>> <</SYS>>", "<|end|>\n<|turn|>user\n", "", "a\\b", "100%25\n%0A", "日😀<s>", "<<s>", "x" * 5000, "\t\r\n"]
    rows = [(c, t, role, text) for c in range(3) for t, text in enumerate(texts) for role in ("user", "assistant", "human", "tool\n%0A<s>", None)[c:c + 3:2]]
    rows += [(7, 0, "assistant", None), (None, None, None, None), (8, 1, "user", "q"), (8, 1, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_turns(chat.canonical_turns(chat.records_of(df), "record", ("conv_id",)))
    out = out.select("conv_id", "formatted", "loss_spans", F.expr(chat.read_turns("formatted")).alias("read"), F.expr(chat.read_loss("formatted", "loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    for conv in got:
        mine = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [tuple(t) for t in got[conv].read] == [(r, x) for _, r, x in mine]
        assert got[conv].loss == [x for _, r, x in mine if r == "assistant"]
        assert not re.search(r"</s>|\[INST\]|<s>|<<SYS>>", got[conv].formatted)
    assert chat.records_of(df.limit(0)).collect() == []


# --- substrings

def brute_repeats(rows, window):
    first = {}
    split = [(d, [w.decode() for w in (t or "").encode().split()]) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i:i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i:i + window])] < d:
                    gone[i:i + window] = [True] * window
        out.append((d, " ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("which,batch", [("odd", 400), ("odd", 1 << 20), ("docs", 40_000), ("hot", 3000)])
def test_repeats_against_brute_force(spark, odd, which, batch):
    if which == "hot":  # a passage in every document, with another surrounding each time
        common = passage(20, 99)
        df = spark.createDataFrame([(i, f"{passage(15, i)} {common} {passage(15, 1000 + i)}") for i in range(200)], "doc_id long, text string")
    else:
        df = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    got = superkmer.remove_repeats(df, batch_bytes=batch, lanes=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_repeats(rows_of(df), 13)


def test_repeats_of_a_very_long_text_and_a_hot_line(spark):
    line = passage(16, 5)
    long = passage(60_000, 8)
    rows = [(i, f"{passage(25, i)}\n{line}\n{passage(9, 500 + i)}") for i in range(150)] + [(900, long), (7000, " ".join(long.split()[20_000:20_100]))]
    got = superkmer.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), batch_bytes=20_000, lanes=2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_repeats(rows, 13)


def test_messages_grow_with_the_batches(spark):
    """A batch sends one message to a lane, however many buckets there are."""
    rows = [(i, passage(300, i)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    size = sum(len(t) for _, t in rows)
    for batches in (8, 32):
        plan = superkmer.remove_repeats(df, batch_bytes=-(-size // batches), lanes=3)
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(lane" in text and "REPARTITION_BY_NUM" in text
        assert "hashpartitioning(bucket" not in text and "hashpartitioning(lane#" in text and text.count("FlatMapGroupsInArrow [lane") >= 1


def test_repeats_carry_columns(odd, empty):
    assert superkmer.remove_repeats(odd, carry=("n_words", "part")).columns == ["doc_id", "kept", "n_words", "n_removed", "part"]
    got = superkmer.remove_repeats(odd, carry=("part", "node", "key"), untouched=True)
    assert got.columns == ["doc_id", "kept", "n_words", "n_removed", "part", "node", "key"]
    assert all((r.part, r.node, r.key) == ("p", "n", 3) for r in got.collect())
    assert {r.kept for r in got.filter("doc_id = 11").collect()} == {"a  a a"}
    assert superkmer.remove_repeats(empty, carry=("part",)).collect() == []


# --- quality rules

def brute_rules(text):
    w = [x.decode() for x in (text or "").encode().split()]
    grams = defaultdict(list)
    for i in range(len(w) - 2):
        grams[tuple(w[i:i + 3])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(map((text or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered))


def test_rules_against_brute_force(odd, empty):
    got = rules.judge(odd, keep=("doc_id", "text", "part"))
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(r.text)
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept)
    assert rules.judge(empty).collect() == []
    assert rules.judge(odd, keep=("doc_id", "n_words")).columns.count("n_words") == 1


def test_rules_keep_clean_and_drop_junk(spark):
    clean = "the river and the old stone house of the town are known to all that live in it for the view on the hills "
    varied = " ".join(f"{clean.split()[i % 22]} word{i}" for i in range(120))
    rows = [(1, varied), (2, " | ".join(passage(1, i) for i in range(200))), (3, " ".join(w + "$$$" for w in (clean * 4).split())), (4, "a line of it\n" * 30)]
    got = {r.doc_id: r.kept for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] and not got[2] and not got[3] and not got[4]


# --- pieces

def test_pieces_without_dropout_are_those_of_the_library(docs):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.Pieces(PIECES)
    for text in [*list(docs.values())[:80], "", " ", "  a   b ", "x\n\ny\tz", "日本 語😀", "é́", "a" * 300, " " * 40 + "x", " q"]:
        assert np.frombuffer(own.encode(text.encode(), b""), "<i4").tolist() == library.encode(text)


def test_pieces_vary_and_decode(spark, odd, empty):
    a, b, c = (pieces.encode(odd, PIECES, dropout=0.2, seed=s) for s in (1, 1, 2))
    ids = [sorted(map(str, df.collect())) for df in (a, b, c)]
    assert ids[0] == ids[1] != ids[2]
    got = pieces.decode(a.filter("doc_id <> 8"), PIECES).collect()
    want = {d: t or "" for d, t in rows_of(odd)}
    assert all(r.decoded == want[r.doc_id] for r in got) and len(got) == 10
    coder = pieces.Pieces(PIECES, 0.3, 5)
    for text in ("▁x ▁", "a▁b", "a" * 200, "ünï 😀" * 30):
        assert coder.decode(np.frombuffer(coder.encode(text.encode(), b"1"), "<i4").tolist()).decode() == text
    assert pieces.encode(empty, PIECES).collect() == []
