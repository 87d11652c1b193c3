"""Operators of texts against brute force, libraries and exact round trips on small tables."""

import base64
import hashlib
import html
import itertools
import os
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sillon.llm import bpe_codec, decontaminate, html_text, media, pretokens, sstable, token_counts

LONG = "lorem ipsum dolor sit amet, " * 4000
TEXTS = [None, "", " ", "a", "Hello  world!\n\n x", "don't  stop  ", "naïve café — 中文 😀 ²³", "aaaaaaaaaaaaaaaa", "x" * 3000, LONG, "Hello  world!\n\n x", "\t\ttab \r\n end ", "<|endoftext|> a<|endoftext|>", "a\x1cb İstanbul ſ ŉ", "0123456789 1,000.5"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, n_tokens int").repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def raw(i):
    return ("no id" if i is None else TEXTS[i] or "").encode()


def test_media(docs):
    got = by_id(media.media_digests(docs))
    assert len(got) == len(TEXTS) + 1
    for i, r in got.items():
        payload = raw(i) + bytes((-len(raw(i))) % 64 or (64 if not raw(i) else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw(i)), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    assert got[0].media_sha256 == got[1].media_sha256 and got[4].media_sha256 == got[10].media_sha256
    assert media.media_digests(docs.limit(0)).count() == 0


def test_ogg_checksum_and_packets():
    def slow(page):
        crc = 0
        for b in page:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
        return crc

    rng = random.Random(1)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert media.page_crc(data) == slow(data)
    packets = [rng.randbytes(n) for n in (0, 1, 254, 255, 256, 510, 70_000, 0, 3)]
    groups = [[(p, 10 * (i + 1))] for i, p in enumerate(packets)]
    stream = media.read_ogg(b"".join(media.pages_of(9, groups)))[9]
    assert stream.packets == packets and stream.granules == [10 * (i + 1) for i in range(len(packets))]
    one = media.read_ogg(b"".join(media.pages_of(9, [[(p, i) for i, p in enumerate(packets)]])))[9]
    assert one.packets == packets
    lengths = list(map(len, packets))
    timed = media.read_ogg(b"".join(media.pages_of(9, [list(zip(packets, itertools.accumulate(lengths), strict=True))])))[9]
    assert None in timed.granules and timed.ends(lengths) == list(itertools.accumulate(lengths)) and timed.seconds(lengths, 10)[-1] == sum(lengths) / 10
    with pytest.raises(media.OggError):
        stream.ends(lengths)


def test_packets_cross_pages_and_every_position_is_checked():
    payload = bytes(range(256)) * 1000
    whole = media.write_ogg(payload)
    sound = media.read_ogg(whole)[media.PCM_SERIAL]
    assert media.read_payload(whole)[0] == payload and sound.pages < len(sound.packets) and None in sound.granules
    at = whole.index(media.CAPTURE, whole.index(b"samples "))  # a later page of samples: a wrong position with a right checksum
    end = whole.index(media.CAPTURE, at + 4)
    page = bytearray(whole[at:end])
    page[6:14] = (int.from_bytes(page[6:14], "little") + 1).to_bytes(8, "little")
    page[22:26] = bytes(4)
    page[22:26] = media.page_crc(bytes(page)).to_bytes(4, "little")
    with pytest.raises(media.OggError):
        media.read_payload(whole[:at] + bytes(page) + whole[end:])


def test_ogg_damage():
    whole = media.write_ogg(bytes(range(64)) * 100)
    for bad in (whole[:-1], whole[:40], whole[:60] + bytes([whole[60] ^ 1]) + whole[61:], b"x" + whole, whole[len(whole) // 2 :]):
        with pytest.raises(media.OggError):
            media.read_ogg(bad)


def test_units_split_like_the_whole():
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\r\n", "'s", "é", "中", "😀", "12", "!", "\t", " "]
    for _ in range(2000):
        x = "".join(rng.choices(parts, k=rng.randint(1, 20)))
        assert [t for u in pretokens.units(x) for t in pretokens.pretokens(pretokens.unit_text(u))] == pretokens.pretokens(x)


def test_cache_is_bounded():
    c = pretokens.Cache(len, entries=3, chars=5)
    assert [c[k] for k in ("a", "bb", "ccc", "dddd", "a", "toolong")] == [1, 2, 3, 4, 1, 7] and len(c) <= 3 and "toolong" not in c


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = by_id(token_counts.token_counts(docs, path, limit=100))
    for i, r in got.items():
        n = len(library.encode(raw(i).decode(), add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(raw(i)), n, n > 100)
    assert token_counts.token_counts(docs.limit(0), path).count() == 0


def test_bpe_codec(docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe_codec.round_trip(docs, path))
    encoded = bpe_codec.encode(docs, path)
    ids, back = by_id(encoded), by_id(bpe_codec.decode(encoded, path))
    for i, r in got.items():
        want = library.encode_ordinary(raw(i).decode())
        assert ids[i].ids == want and bytes(back[i].bytes) == raw(i)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(raw(i)).hexdigest())
    codec = bpe_codec.Codec(path)
    rng = random.Random(3)
    for _ in range(300):  # repeated letters overlap
        w = "".join(rng.choices("aabs ", k=rng.randint(1, 40)))
        assert codec.encode_block([w]) == [library.encode_ordinary(w)]


def test_token_shards(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = sorted(sstable.token_shards(docs, path).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    start = 0
    for r in rows:
        ids = library.encode(raw(r.doc_id).decode(), add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sstable.token_shards(docs.limit(0), path).count() == 0
    other = P.path("byte_bpe_50k.json")  # keeps white space: nothing but the library may cut its texts
    texts = ["a  b", " a\n\nb ", "", "Hello World"]
    assert [np.frombuffer(x, "<u2").tolist() for x in sstable.Encoder(other, 1).encode(texts)] == [Tokenizer.from_file(other).encode(x, add_special_tokens=False).ids + [1] for x in texts]
    again = spark.createDataFrame([(5, "b"), (5, "a"), (5, "b"), (-3, "c"), (9, "d")], "doc_id long, text string")
    shards = sstable.write_shards(again, path, f"file://{tmp_path}/shards")
    found = {k: [x.tolist() for s in shards for x in sstable.Shard(s.uri).get(k)] for k in (5, -3, 9, 6)}
    assert sorted(map(len, found.values())) == [0, 1, 1, 3]
    assert found[9] == [library.encode("d").ids + [1]]


def test_shard_lookup(tmp_path):
    with open(tmp_path / "s", "wb") as f:
        w = sstable.ShardWriter(f, 4)
        for k in range(-2000, 5000, 3):
            w.add(sstable.key_of(k), np.arange(abs(k) % 50, dtype="<u4").tobytes())
        w.close()
    s = sstable.Shard(f"file://{tmp_path}/s")
    assert len(s.blocks) > 1 and s.n_docs == len(range(-2000, 5000, 3))
    for k in range(-2010, 5010):
        assert [len(x) for x in s.get(k)] == ([abs(k) % 50] if k in range(-2000, 5000, 3) else [])
    data = bytearray((tmp_path / "s").read_bytes())
    data[100] ^= 1
    (tmp_path / "s").write_bytes(bytes(data))
    with pytest.raises(sstable.ShardError):
        list(sstable.Shard(f"file://{tmp_path}/s"))


def brute_contamination(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words, hit, found = word.findall(low(text)), set(), []
    for k, t in items:
        own = word.findall(low(t))
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        here = [i for i in range(len(words) - n + 1) if n and tuple(words[i : i + n]) in windows]
        found += [str(k)] * bool(here)
        hit |= {j for i in here for j in range(i, i + n)}
    found.sort()
    return len(words), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize(("limit", "spool"), [(decontaminate.SLICE_BYTES, 0), (900, 0), (900, 1 << 20)])
def test_contamination(spark, monkeypatch, limit, spool):
    monkeypatch.setattr(decontaminate, "SPOOL_BYTES", spool)
    rng = random.Random(4)
    letters = ["a", "B", "é", "ÉX", "7", "dog", "the"]
    text = lambda n: "".join(rng.choice(letters) + rng.choice([" ", ", ", "\n", "-", "  "]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(12, None), (13, "Dog the dog"), (14, "Dog the dog")]
    docs = [(i, text(rng.randint(0, 60)) + (items[i % 12][1] or "") + text(5)) for i in range(60)] + [(60, None), (61, ""), (62, "dog The-dog")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.contamination(d, b, limit=limit, spans=True))
    for i, t in docs:
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_contamination(t, items)
        words = sum(len(decontaminate.words_of(t[slice(*map(int, s.split("-")))])) for s in r.spans)
        assert words == r.n_hit
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == sorted(i for i, t in docs if not got[i].contaminated)
    assert decontaminate.contamination(d, b.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(d.limit(0), b).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><p>the tagline of a great site, long enough to be text</p></header>
<nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies on this site to make it better for all.</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First para, with <a href='x'>link</a> and caf&eacute;.<p>Second<br>line &amp;amp; more.
<div class="ad">Buy now!</div><aside><p>Related stuff is here for you to read</p></aside><ul><li>one item</li><li>two items</li></ul><script>if (a<b) {"</p>"}</script>
<p>Short.</p><!-- <p>no</p> --><form><input><label>Email</label></form><section id="comments"><h2>Comments</h2><p>I like this article very much, thank you.</p></section></article></main>
<div id="sidebar"><p>Popular posts this week on our site</p></div><footer>&copy; 2020</footer></body>"""


def test_html_blocks():
    assert html_text.main_blocks(PAGE) == ["Title & more", "First para, with link and café.", "Second line &amp; more.", "one item", "two items", "Short."]
    plain = "<p>A page without any article tag that has words enough to be taken for text.</p><p>And one more paragraph of it, also long enough to be kept here.</p><ul><li><a href=#>x</a><li><a href=#>y</a></ul>"
    assert len(html_text.main_blocks(plain)) == 2
    for odd in ("", "<script>x", "<!-- x", '<a href="x', "<p", "</p></div>", "<style>"):
        assert html_text.main_text(odd) == ""


def test_html_query(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, None), (3, "u", "", None), (1, "u", PAGE, "x"), (4, "u", "<article>" + "<p>word" * 5000, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text.count("\n") for r in got} == {1: 5, 2: 0, 3: 0, 4: 4999}


def test_tree_fits_its_table():
    for line in html_text.TABLE.strip().splitlines():
        blocks, keep = html_text.labelled(line)
        assert [int(html_text.tree().predict(html_text.features(blocks, i))) for i in range(len(blocks))] == keep


def test_furniture_never_passes():
    """Whatever stands beside it."""
    block = lambda place, words, density, heading=False, item=False: html_text.Block("", words, round(words * density), place, heading, item)
    for place, words, density, heading, item in itertools.product((html_text.FURNITURE, html_text.OUTSIDE), (1, 6, 90), (0, 0.5, 1), (False, True), (False, True)):
        for before, after in itertools.product([block(html_text.ARTICLE, w, d) for w in (1, 50) for d in (0, 1)], repeat=2):
            assert html_text.tree().predict(html_text.features([before, block(place, words, density, heading, item), after], 1)) == 0


def random_page(rng):
    """A page and the text of its article, which is known since the page is made of it."""
    words = lambda a, b: " ".join("".join(rng.choices("aeiourstln", k=rng.randint(2, 9))) for _ in range(rng.randint(a, b)))
    link = lambda: f"<a href='/{rng.randint(0, 99)}'>{words(1, 3)}</a>"
    menu = lambda: f"<nav><ul>{''.join(f'<li>{link()}</li>' for _ in range(rng.randint(1, 6)))}</ul></nav>"
    inside, want = [], []

    def keep(open_, text, close):
        inside.append(open_ + text.replace(" ", rng.choice([" ", "  ", "\n", "&nbsp;"])) + close)
        want.append(text)

    def drop():
        return rng.choice([menu(), f"<div class='ad'>{words(1, 40)}</div>", f"<!-- {words(1, 9)} -->", f"<script>{words(1, 9)}</script>", f"<aside><p>{words(5, 50)}</p></aside>", f"<div id='comments'><h3>{words(1, 2)}</h3><p>{words(5, 60)}</p></div>", f"<form><label>{words(1, 3)}</label></form>", f"<p class='cookie-notice'>{words(3, 30)}</p>"])

    keep("<h1>", words(1, 9), "</h1>")
    for _ in range(rng.randint(1, 12)):
        kind = rng.randrange(8)
        if kind == 0:
            keep("<h2 id='related-work'>", words(1, 5), "</h2>")
        elif kind == 1:
            keep("<ul><li>", words(1, 12), "</li></ul>")
        elif kind == 2:
            keep("<p><b>", words(1, 60), "</b></p>")
        elif kind == 3:
            keep("<p>", words(1, 9), "</p>")
        elif kind == 4:
            keep("<p><a href=x>", words(4, 15), "</a></p>")
            keep("<p>", words(8, 30), "</p>")
        elif kind == 5:
            inside.append(drop())
        else:
            keep("<p>", words(20, 120), "</p>")
    tag = rng.choice(["article", "main"])
    around = [menu(), f"<header><p>{words(1, 20)}</p></header>", *(drop() for _ in range(rng.randint(0, 3)))]
    page = f"<html><head><title>{words(2, 5)}</title></head><body>{''.join(around)}<{tag}>{''.join(inside)}</{tag}>{drop()}<footer>&copy; {words(1, 30)}</footer></body></html>"
    return page, "\n".join(want)


def test_made_pages_give_their_articles():
    rng = random.Random(21)
    for _ in range(400):
        page, want = random_page(rng)
        assert html_text.main_text(page) == want


def test_odd_articles():
    long = " ".join(["word"] * 60)
    assert html_text.main_blocks(f"<nav><a href=/>Home</a></nav><article><p>{long}</p></article>") == [long]
    assert html_text.main_blocks("<article><p>Intro words here.</p><p><a href=x>A whole paragraph in a link</a></p><p>End words.</p></article>") == ["Intro words here.", "A whole paragraph in a link", "End words."]
    assert html_text.main_blocks("<body><h1>Title</h1><p>Only seven words are in this one.</p></body>") == ["Title", "Only seven words are in this one."]
    assert html_text.main_blocks(f"<div class='text-center'>Hi</div><p>{long}</p><p>short one.</p>")[1:] == [long, "short one."]
    assert html_text.main_blocks(f"<div class=content><p>{long}</p></div><p>outside of it</p>") == [long]
    assert html_text.main_blocks(f"<article><section id='discussion'><p>{long}</p></section></article>") == [long]
    menu = "".join(f"<li><a href=/{i}>go there</a></li>" for i in range(5))
    assert html_text.main_blocks(f"<ul>{menu}</ul><h1>On words</h1><p>{long}</p><p>{long}</p><ul>{menu}</ul>") == ["On words", long, long]


def test_odd_markup_takes_linear_time():
    began = time.perf_counter()
    for page in ("<div>" * 50_000 + "</p>" * 50_000, "<svg>" * 50_000, "<button>x" * 50_000, "<div>" * 50_000 + "</div>" * 50_000, "<p><a " * 50_000):
        html_text.main_blocks(page)
    assert time.perf_counter() - began < 15


def test_pages_of_the_tables():
    """All that an article element holds, by regular expressions alone, on the given pages."""
    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    for page in pq.read_table(path, columns=["html"]).column(0).to_pylist():
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>|</?[a-z]+[^>]*>", lambda m: "\n" if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:h1|p)\b[^>]*>", article)]
        assert html_text.main_blocks(page) == [b for b in blocks if b]


def test_html_names_that_only_look_like_furniture():
    """States, layouts and wrappers don't take an article away; real furniture in them goes."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    inside = f"<p>{a}</p><p>{b}</p>"
    menu = "<nav><a href=/>Home</a></nav>"
    for page in (
        f'{menu}<main class="has-sidebar">{inside}</main><footer>x</footer>', f'{menu}<article class="post share-enabled">{inside}</article>', f'<form action="/x">{menu}{inside}<input></form>',
        f'<form id=aspnetForm><div>{menu}</div><article>{inside}</article><footer>{c}</footer></form>', f'<div class="sidebar-layout"><main>{inside}</main><aside>{c}</aside></div>', f'<main class="no-comments">{inside}</main>',
        f'<div class="modal-open">{inside}</div>', f'<body class="single sidebar-right">{inside}</body>', f'<div class="page overlay">{menu}{inside}</div>', f'<main>{inside}<ol class="replies"><li>{c}</li></ol></main>',
        f'<article>{inside}</article><form class="search"><p>{c}</p></form>', f'<article>{inside}<div class="share-buttons">{c}</div></article>', f'<main>{inside}<section id="comments"><article class="comment-body"><p>{c}</p></article></section></main>',
        f'<article>{inside}</article><div class="comments-area"><p>{c} {c} {c} {c} {c} {c} {c} {c} {c} {c} {c} {c} {c} {c} {c} {c} {c} {c} {c} {c} {c} {c} {c} {c}</p></div>', f'<main>{inside}<div class="is-hidden"><p>{c}</p></div></main>',
    ):
        assert html_text.main_blocks(page) == [a, b], page
    assert html_text.main_blocks(f'<article><p class="overflow-hidden">{a}</p><p>{b}</p></article>') == [a, b]
    assert html_text.main_blocks(f'<div class="comments"><p>{a}</p></div>') == []


def test_html_repeated_rows_and_clashing_columns(spark):
    page = "<article><p>" + "word " * 30 + "</p></article>"
    rows = [(1, "u", page, 9, "x")] * 3 + [(None, None, None, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 149), (1, 149), (1, 149)]


def naive_merges(word, ranks):
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        rank, at = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(ranks[p] for p in parts)


def test_replay_equals_naive_merging_for_any_ranks(tmp_path):
    """Files whose ranks no training gave: tokens in any order, several ways to make one."""
    rng = random.Random(17)
    path = tmp_path / "ranks"
    for n in range(60):
        tokens = list({bytes(rng.choices(b"abc"[: rng.randint(2, 3)], k=rng.randint(2, 6))) for _ in range(rng.randint(5, 60))})
        rng.shuffle(tokens)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        words = [bytes(rng.choices(b"abc", k=rng.randint(1, 25))) for _ in range(400)]
        assert bpe_codec.Codec(str(path)).replay(words) == [naive_merges(w, ranks) for w in words], n
    path.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(256)))
    assert bpe_codec.Codec(str(path)).replay([b"ab", b"", b"c"]) == [(97, 98), (), (99,)]  # nothing merges
    letters = {b"ca": 256, b"aa": 257, b"aaca": 258, b"ba": 259, b"aabaa": 263, b"aab": 268}
    ranks = {bytes([b]): b for b in range(256)} | letters
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    assert bpe_codec.Codec(str(path)).replay([b"aaaabaabc"]) == [(257, 263, 98, 99)]
