"""Edge cases and brute force on small fixtures, a section for each operator."""

import hashlib
import html
import random
import re
from html.parser import HTMLParser

import numpy as np
import pytest

from quillspan.llm import chat, common, components, contamination, language, neardup, pages, pieces, privacy, quality, substrings, warc

DOCS = "doc_id bigint, text string"
LONG = "und so weiter die Straße " * 4000


def edge_docs(spark):
    """Nulls, empties, blanks, one long text, repeated rows, and columns that clash with the operators' own."""
    rows = [
        (1, None, None), (2, "", "x"), (3, " \t\n\x0b\x0c\r ", None), (4, LONG, "x"), (5, "word", None), (5, "word", None),
        (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "x"), (7, "a b c d e f g h i j k l m n o p q r s t u v w x y z", None), (None, "null id", None),
    ]
    clash = "n_words string, kept string, text_id string, key bigint, node string, spans string, hit_spans string, pii_spans string, ids string, mark bigint, _w string, class_id string, score string"
    names = clash.count(",") + 1
    return spark.createDataFrame([(i, t, *([c] + [None] * (names - 1))) for i, t, c in rows], f"{DOCS}, {clash}")


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- common -----------------------------------------------------------------


def test_words_and_hashes():
    texts = ["", "one", " one  two\n", " x y", "two one"]
    raw = "".join(texts).encode()
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    data = np.frombuffer(raw, np.uint8)
    s, e, first = common.word_bounds(data, off)
    assert [raw[a:b] for a, b in zip(s, e)] == [w for t in texts for w in t.encode().split()]
    assert np.diff(first).tolist() == [len(t.encode().split()) for t in texts]
    h = common.word_hashes(data, s, e)
    assert h[0] == h[1] == h[6] and h[2] == h[5] and len(set(h.tolist())) == 4
    assert common.gram_hashes(h, 2)[0] != common.gram_hashes(h, 2)[1]


def test_run_tables():
    import pyarrow as pa

    keys = sorted(random.Random(1).choices(range(40), k=500))
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + 7]}) for i in range(0, 500, 7)]
    tables = [t.column("k").to_pylist() for t in common.run_tables(iter(batches), "k")]
    assert sum(tables, []) == keys
    assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))


def test_components(spark):
    rnd = random.Random(2)
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [(f"{rnd.randrange(100, 180)}", f"{rnd.randrange(100, 180)}") for _ in range(50)] + [("200", "200")]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert components.components(spark.createDataFrame([], "u string, v string")).count() == 0


# --- 1 ----------------------------------------------------------------------


@pytest.mark.parametrize("block", [1024, 8])
def test_jaccard_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", block)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 3, 5, 6, 20, 60, 120]))]
        for _ in range(rnd.choice([1, 2, 5, 9])):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "  ", None, "a", "a ", "a"])]
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.jaccard_links(spark.createDataFrame(rows, DOCS), sent=0 if block == 8 else neardup.SENT).collect()}
    assert got == neardup.brute_force(rows)


def test_jaccard_empty_blocks(spark, monkeypatch):
    """Near copies in one block, beside blocks that stay empty, count once."""
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 1)
    texts = [" ".join(f"g{g}w{i}" for i in range(60)) for g in range(12)]
    rows = [(2 * g + i, t + " end" * i) for g, t in enumerate(texts) for i in range(2)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.jaccard_links(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == neardup.brute_force(rows) and {n for _, n in got.values()} == {1}


def test_jaccard_repeated_rows(spark):
    """Rows of one id and text count each, also with a near copy."""
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(5, x), (5, x), (6, x + " end"), (None, y), (None, y), (7, y + " end"), (8, z), (8, z)]
    got = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in neardup.jaccard_links(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 7, 2), (0, 7, 2), (5, 5, 2), (5, 5, 2), (6, 5, 2), (7, 7, 2), (8, 8, 1), (8, 8, 1)]


def test_jaccard_edges(spark):
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in neardup.jaccard_links(edge_docs(spark)).collect())
    assert got == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 1), (5, 5, 1), (6, 6, 1), (7, 6, 1)]
    assert neardup.jaccard_links(empty(spark)).count() == 0
    kept = neardup.keep_one(edge_docs(spark))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 5, 6]
    assert kept.columns == edge_docs(spark).columns


def test_pruning_bound():
    """A pair at the threshold stays under the bound at every step with near certainty."""
    from math import comb

    lost = sum(sum(comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(need)) for n, need in neardup.NEEDED.items())
    assert lost < 1e-7
    assert neardup.NEEDED[128] > 64


# --- 2 ----------------------------------------------------------------------


def test_substrings_brute_force(spark):
    rnd = random.Random(4)
    parts = [[rnd.choice("abcdefgh") + str(rnd.randrange(40)) for _ in range(n)] for n in (20, 21, 40, 19, 90)]
    rows = []
    for i in range(60):
        t = []
        for _ in range(rnd.randrange(4)):
            t += rnd.choice(parts) if rnd.random() < 0.6 else [rnd.choice("xyz") + str(rnd.randrange(500)) for _ in range(rnd.randrange(30))]
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(t)))
    rows += [(100, None), (101, ""), (102, " ".join(["same"] * 100)), (103, " ".join(["same"] * 30))]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    for hot in (substrings.HOT, 3, 1):  # common anchors' windows one by one
        got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in substrings.remove_repeats(df, hot).collect()}
        assert got == substrings.brute_force(rows)


def test_substrings_hot_anchor(spark):
    """An anchor with 100 000 contexts: its windows pass in order, nothing of it is gathered."""
    head, rest = "a b c d e f", " ".join(f"k{i}" for i in range(13))
    rows = [(i, f"{head} {rest} x{i % 60_000}") for i in range(100_000)]
    df = spark.createDataFrame(rows, DOCS).repartition(8)
    for hot in (substrings.HOT, 4):
        got = dict(substrings.remove_repeats(df, hot).groupBy("n_removed").count().collect())
        assert got == {0: 60_000, 20: 40_000}


def test_substrings_edges(spark):
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.remove_repeats(edge_docs(spark)).collect())
    assert [g for g in got if g[0] != 4] == [(0, 2, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (5, 1, 0), (5, 1, 0), (6, 26, 0), (7, 26, 26)]
    assert got[4] == (4, 20000, 19995)  # five words over and over: windows from the sixth word on are repeats
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_substrings_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    got = substrings.remove_repeats(spark.createDataFrame([(1, t), (1, t), (2, t)], DOCS)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 30)]


def test_substrings_windows_of_one_anchor(spark):
    """Two windows that share their anchor, its offset and half of their hash are still different."""
    import numpy as np

    def hashes(texts, k):
        data = " ".join(texts).encode()
        starts, ends, _ = common.word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        return common.gram_hashes(common.word_hashes(np.frombuffer(data, np.uint8), starts, ends), k)

    runs = [f"a{i} b c d e f" for i in range(40_000)]
    head = runs[int(np.argmin(hashes(runs, substrings.SEED)[:: substrings.SEED]))]
    windows = [head + " g h i j k l m n o p q r s" + f" x{i}" for i in range(300_000)]
    half = hashes(windows, substrings.LENGTH)[:: substrings.LENGTH] >> np.uint64(32)
    order = np.argsort(half, kind="stable")
    i = int(np.flatnonzero(half[order][1:] == half[order][:-1])[0])
    rows = [(0, windows[order[i]]), (1, windows[order[i + 1]]), (2, windows[order[i]])]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {0: 0, 1: 0, 2: 20}


# --- 3 ----------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string"


def test_pages_noise(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><p>no';</script></head><body class='x comments-open'>"
        "<header><h1>Site</h1></header><nav><a href=/>menu</a></nav><div class='cookie-notice'>we use cookies</div><!-- no <p>x</p> -->"
        "<div class='post-12'><h1>A&amp;B</h1><p>one\n two<br>three <b>bo</b>ld<p>&lt;four&gt; &#233;<form>mail<input></form><aside>side</aside>"
        "<ul><li>five<li>six</ul><div class='ads'>buy</div></div><section id=comments><p>nice post, I liked it very much indeed</p></section><footer>foot</footer></body></html>"
    )
    got = pages.extract_main_text(spark.createDataFrame([(1, "http://h.example/1", page)], PAGES)).first()
    assert got.text == "A&B one two three bold <four> é five six"


def test_pages_consensus(spark):
    """A page whose own best container would be another goes by its host."""
    page = lambda main, other: f"<body><div class='main-1'><p>{main}</p></div><div class='list-2'><p>{other}</p></div></body>"
    rows = [(i, "https://H.example/a", page("word " * 50, "x")) for i in range(5)] + [(9, "https://h.example/b", page("short", "list " * 40)), (10, "https://other.example/", page("short", "list " * 40))]
    got = {r.page_id: r.text for r in pages.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[9] == "short" and got[10] == " ".join(["list"] * 40)
    joined = {r.page_id: r.text for r in pages.extract_main_text(spark.createDataFrame(rows, PAGES), sent_hosts=0).collect()}
    assert joined == got


def test_pages_inline_headers_and_names(spark):
    page = (
        "<body><div class='site-header'>Site</div><article class='notice-board'><header><h1>Own title</h1></header><p>lead <button>Buy</button>text <span class='share-links'>tweet</span>goes on "
        "<select><option>x</select>here</p><section><p class='related-work'>first part</p></section><section><h2>Second</h2><p>a &<b>lt;</b> b &lt; c</p></section>"
        "<div class='comment-list'>me too</div><footer>by me</footer></article><div class='ad-slot'>buy</div></body>"
    )
    got = pages.extract_main_text(spark.createDataFrame([(1, "http://h.example/1", page)], PAGES)).first()
    assert got.text == "Own title lead text goes on here first part Second a &lt; b < c"


def test_pages_votes_that_tie_and_long_pages(spark):
    same = "<body><div class='b'><p>one two</p></div><div class='a'><p>six ten</p></div></body>"
    long = "<body><article><p>" + "</p><p>".join(f"word{i} &amp; more" for i in range(200_000)) + "</p></article></body>"
    got = {r.page_id: r.text for r in pages.extract_main_text(spark.createDataFrame([(1, "http://t.example/", same), (2, "http://l.example/", long)], PAGES)).collect()}
    assert got[1] == "one two"  # of equal votes the last path by name
    assert got[2] == " ".join(f"word{i} & more" for i in range(200_000))


class Tree(HTMLParser):
    """A page as a tree of (tag, names, noisy, children); a child is a node or a text."""

    def __init__(self, source):
        super().__init__(convert_charrefs=False)
        self.root = ["", [], False, []]
        self.open = [self.root]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attributes):
        if tag in pages.TRACKED:
            for ended in (["p"] if tag in pages._ENDS_P else [], pages._SAME.get(tag, ())):
                if self.open[-1][0] in ended:
                    self.open.pop()
        names = dict(attributes)
        node = [tag, sorted(re.sub("[0-9]+", "#", x) for x in (names.get("class") or "").lower().split()), any(pages._noisy((names.get(k) or "").lower()) for k in ("class", "id", "role")), []]
        self.open[-1][3].append(node)
        if tag in pages.TRACKED:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag == "a":
            self.open[-1][3].append(["/a", [], False, []])
        if tag in pages.TRACKED and any(n[0] == tag for n in self.open):
            self.open[-1][3].append(["/", [], False, []])
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.lasttag not in ("script", "style") or self.open[-1][3] and self.open[-1][3][-1][0] not in ("script", "style"):
            self.open[-1][3].append(data)

    def handle_entityref(self, name):
        self.open[-1][3].append(f"&{name};")

    def handle_charref(self, name):
        self.open[-1][3].append(f"&#{name};")


def tree_texts(source):
    """(path, parent path, text) of all texts that aren't skipped, by a walk over the tree; None ends a block."""
    out, link = [], [False]

    def walk(node, path, above, article):
        for x in node[3]:
            if isinstance(x, str):
                out.append((path, above, x, link[0]))
                continue
            tag, names, noisy, _ = x
            if tag in pages.BLOCKS or tag == "/":
                out.append(None)
            if tag in ("a", "/a"):
                link[0] = tag == "a"
            if tag not in pages.TRACKED or tag in ("script", "style") or (noisy and tag not in ("html", "body")) or tag in pages.SKIPPED and not (tag == "header" and article):
                continue
            own = tag in pages.CONTAINERS and not (article and (tag == "section" or tag == "div" and not names))
            walk(x, *((f"{path}/{'.'.join([tag, *names])}", path) if own else (path, above)), article or tag == "article")

    walk(Tree(source).root, "", None, False)
    return out


def test_pages_tree_walk(spark, sf_dir):
    """Votes and texts of the table's pages by a plain walk over a parsed tree."""
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r.page_id, re.sub("^[a-z]+://([^/?#]*).*", r"\1", (r.url or "").lower()), tree_texts(r.html or "")) for r in df.collect()]
    votes = {}
    for _, host, texts in rows:
        for t in texts:
            if t and not t[3]:
                n = len(t[2].strip())
                votes[host, t[0]] = votes.get((host, t[0]), 0) + 2 * n
                if t[1] is not None:
                    votes[host, t[1]] = votes.get((host, t[1]), 0) + n
    best = {h: max((n, p) for (g, p), n in votes.items() if g == h)[1] for h in {h for h, _ in votes}}
    got = {r.page_id: r.text for r in pages.extract_main_text(df).collect()}
    for page, host, texts in rows:
        inside = lambda p: p == best[host] or p.startswith(best[host] + "/")
        assert got[page] == " ".join(html.unescape("".join("\n" if t is None else t[2] if inside(t[0]) else "" for t in texts)).split()), page


def test_pages_edges(spark):
    rows = [(1, None, None), (2, "x", ""), (3, None, "<p>unclosed <b>bold"), (3, None, "<p>unclosed <b>bold"), (None, "not a url", "plain &lt; text"), (5, None, "</div></p>< x <3 " + "<div>" * 3000 + "deep"), (6, None, '<a href="x>never closed')]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], PAGES + ", host string, path string")
    got = sorted((r.page_id or 0, r.text) for r in pages.extract_main_text(df).collect())
    assert got[:5] == [(0, "plain < text"), (1, ""), (2, ""), (3, "unclosed bold"), (3, "unclosed bold")]
    assert len(got) == 7
    assert pages.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


# --- 4 ----------------------------------------------------------------------


def test_archive_round_trip(spark):
    rows = [(3, "u\r\nv", "same"), (1, "a", "same"), (2, None, None), (4, "b", ""), (5, "c", "WARC/1.1\r\n\r\né"), (5, "c", "WARC/1.1\r\n\r\né"), (None, "d", "null id"), (7, "e", "null id")]
    path = common.shared_dir(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([(*r, "z") for r in rows], PAGES + ", payload string"), path)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes, r.payload_digest) for r in warc.read_pages(spark, path).collect())
    assert [g[:4] for g in got] == [(0, "response", 0, 7), (1, "response", 0, 4), (2, "response", 0, 0), (3, "revisit", 1, 4), (4, "revisit", 2, 0), (5, "response", 0, 14), (5, "response", 0, 14), (7, "revisit", 0, 7)]
    import base64

    assert got[1][4] == base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    records = {r.record_id: bytes(r.record) for r in warc.read_records(spark, path).collect()}
    head, _, rest = records[5].partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and rest == "WARC/1.1\r\n\r\né".encode() + b"\r\n\r\n"
    assert b"WARC-Refers-To: <urn:record:1>" in records[3] and records[3].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")


def test_warc_files(spark, tmp_path):
    """Records that are written to files, plain and gzipped, come back byte for byte."""
    path = common.shared_dir(spark, "test-warc")
    bodies = {1: "a", 2: "b\r\n\r\nWARC/1.1\r\n", 3: "", 4: "a"}
    warc.write_archive(spark.createDataFrame([(i, "u", h) for i, h in bodies.items()], PAGES), path)
    records = [bytes(r.record) for r in warc.read_records(spark, path).orderBy("record_id").collect()]
    (tmp_path / "x.warc").write_bytes(b"".join(records) + b"WARC/1.1\r\nContent-Length: 9\r\n\r\ncut")
    (tmp_path / "y.warc.gz").write_bytes(b"".join(map(warc.gzip_member, records)))
    got = warc.read_warc_files(spark, str(tmp_path)).orderBy("path", "offset").collect()
    assert [bytes(r.header) + bytes(r.content) + b"\r\n\r\n" for r in got] == records * 2
    assert [bytes(r.content).decode() for r in got[:4]] == ["a", bodies[2], "", ""]


def test_archive_empty_and_small(spark):
    path = common.shared_dir(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([], PAGES), path)
    assert warc.read_pages(spark, path).count() == 0
    path = common.shared_dir(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([(1, "", "ab"), (2, "", "ab"), (3, "", "abc"), (4, "", "abc")], PAGES), path, least_bytes=3)
    assert [r.record_type for r in warc.read_pages(spark, path).orderBy("page_id").collect()] == ["response", "response", "response", "revisit"]


def test_archive_notices_damage(spark):
    path = common.shared_dir(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([(1, "", "ab")], PAGES), path)
    bad = common.shared_dir(spark, "test-warc")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{bad}/headers")
    spark.read.parquet(f"{path}/payloads").selectExpr("payload_sha256", "first_id", "CAST('ac' AS BINARY) AS payload").write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="isn't the one stored"):
        warc.read_pages(spark, bad).collect()


# --- 5 ----------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    out = []
    for k in privacy.KINDS:
        for m in re.finditer(PATTERNS[k], t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == "card" and not (14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if k == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out, key=lambda s: (s[0], privacy.KINDS.index(s[1])))


def test_base_spans():
    rnd = random.Random(5)
    pieces_ = ["a", "@", ".", "1", "25", "+", " ", "-", "(", ")", "é", "b.c@d.e", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (234) 555-0000", "%", "x.y", "007"]
    for _ in range(20000):
        t = "".join(rnd.choice(pieces_) for _ in range(rnd.randint(0, 14)))
        assert privacy.base_spans(t) == plain_spans(t), t
    assert privacy.base_spans("1" * 200_000 + "." + "@" * 50_000) == []


def test_disclosure(spark):
    docs = [(i, f"the report by Zyx about a@b.cd and the weather {i}") for i in range(5)] + [(i, f"the weather by the sea {i}") for i in range(5, 60)] + [(60, "only once 10.0.0.1 rare")]
    df = spark.createDataFrame(docs, DOCS)
    out = privacy.find_personal_data(df)
    spans = {r.doc_id: [(s.kind, docs[r.doc_id][1][s.start : s.end]) for s in r.pii_spans] for r in out.collect()}
    assert spans[0] == [("term", "report"), ("term", "Zyx"), ("term", "about"), ("email", "a@b.cd"), ("term", "and")]
    assert spans[10] == [] and spans[60] == [("ip", "10.0.0.1")]
    joined = {r.doc_id: [(s.kind, docs[r.doc_id][1][s.start : s.end]) for s in r.pii_spans] for r in privacy.find_personal_data(df, sent=0).collect()}
    assert joined == spans
    for sent in (privacy.SENT, 0):
        clean = {r.doc_id: r.text for r in privacy.sanitised(df, sent=sent).collect()}
        assert clean[0] == "the [TERM] by [TERM] [TERM] [EMAIL] [TERM] the weather 0" and clean[10] == docs[10][1] and clean[60] == "only once [IP] rare"


def test_disclosure_of_rare_values(spark):
    """Values of one or two documents, far terms, identifiers and names: enough documents stand in for support."""
    docs = [(i, f"Ana Costa met Rui Silva by the sea on day {i % 50}") for i in range(1500)]
    far = " ".join(["the sea"] * 40)
    docs += [(1500, f"x9-77k {far} a@b.cd {far} kappa Rui Costa"), (1501, f"sigma {far} c@d.ef"), (1502, f"c@d.ef {far} sigma on day 7")]
    for sent in (privacy.SENT, 0):
        out = privacy.find_personal_data(spark.createDataFrame(docs, DOCS), sent=sent)
        spans = {r.doc_id: [(s.kind, docs[r.doc_id][1][s.start : s.end]) for s in r.pii_spans] for r in out.collect()}
        assert spans[1500] == [("term", "x9-77k"), ("email", "a@b.cd"), ("term", "kappa"), ("term", "Rui Costa")]
        assert spans[1501] == [("term", "sigma"), ("email", "c@d.ef")] and spans[1502] == [("email", "c@d.ef"), ("term", "sigma")]
        assert not any(spans[i] for i in range(1500))


def test_disclosing_pairs_brute_force(spark):
    """Counts of all disclosing pairs equal plain counting, at several thresholds; the scans' tables change nothing."""
    rnd = random.Random(11)
    words = ["Ana", "Rui", "x9", "77k", "sea", "İstanbul", "ΣΑΣ", "Straße", "a_b", "v1.2", "12/34", "ß", "day", "7", "e\u0301t", "𝒳y"]
    texts = []
    for i in range(400):
        t = rnd.choice([" ", ", "]).join(rnd.choice(words) + rnd.choice(["", "", str(rnd.randint(0, 90))]) for _ in range(rnd.randint(0, 12)))
        if i % 9 == 0:
            t += rnd.choice([" a@b.cd ", " c@d.ef,", " 10.0.0.1 ", " +1 (234) 555-0000 x", " 4111 1111 1111 1111"]) + rnd.choice(words)
        texts.append(t)
    texts += [None, "", texts[0], texts[9]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    for d in (0.3, 0.6, 0.9):
        got = {(r.entity, r.term): (r.ne, r.nt, r.net) for r in privacy.disclosing_terms(df, d).collect()}
        assert got == privacy.brute_force(texts, d) and (d > 0.6 or got)
    for d in (0.3, 0.6):
        sent = {r.doc_id: r.pii_spans for r in privacy.find_personal_data(df, disclosure=d).collect()}
        assert sent == {r.doc_id: r.pii_spans for r in privacy.find_personal_data(df, sent=0, disclosure=d).collect()}
        terms = {t for _, t in privacy.brute_force(texts, d)}
        found = {texts[k][s.start : s.end].lower() for k, x in sent.items() for s in x if s.kind == "term" and " " not in texts[k][s.start : s.end]}
        assert found and {x for x in found if x in terms}


def test_disclosure_without_the_value(spark):
    """A term that gives a value away is a span in documents that don't have the value too."""
    docs = [(i, f"the sea is calm on day {i % 50}") for i in range(70000)] + [(70001, "a@b.cd met kappa"), (70002, "kappa alone")]
    df = spark.createDataFrame(docs, DOCS)
    for sent in (privacy.SENT, 0):
        out = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii_spans] for r in privacy.find_personal_data(df, sent=sent).where("doc_id > 70000").collect()}
        assert out == {70001: [("email", 0, 6), ("term", 7, 10), ("term", 11, 16)], 70002: [("term", 0, 5)]}


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_terms_on_the_tables(spark, size):
    docs = spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet")
    texts = [r.text for r in docs.select("text").collect()]
    got = {(r.entity, r.term): (r.ne, r.nt, r.net) for r in privacy.disclosing_terms(docs, 0.8).collect()}
    assert got == privacy.brute_force(texts, 0.8)
    found = privacy.find_personal_data(docs, disclosure=0.8)
    assert (found.selectExpr("sum(size(filter(pii_spans, s -> s.kind = 'term'))) AS n").first().n > 0) == bool(got)
    plain = {r.doc_id: [tuple(s) for s in r.pii_spans if s.kind != "term"] for r in found.select("doc_id", "pii_spans").collect()}
    assert plain == {r.doc_id: [(k, a, z) for a, k, z in privacy.base_spans(r.text or "")] for r in docs.collect()}


def test_privacy_edges(spark):
    assert all(r.pii_spans == [] for r in privacy.find_personal_data(edge_docs(spark)).collect())
    assert privacy.find_personal_data(empty(spark)).count() == 0
    clean = privacy.sanitised(edge_docs(spark))
    assert sorted(map(str, clean.select("doc_id", "text").collect())) == sorted(map(str, edge_docs(spark).select("doc_id", "text").collect()))


# --- 6 ----------------------------------------------------------------------


def test_automaton_brute_force():
    rnd = random.Random(6)
    for _ in range(300):
        words = ["a", "b", "C", "É", "d1"][: rnd.randint(2, 5)]
        items = [(str(i), " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 5, 13, 14, 20])))) for i in range(rnd.randint(1, 4))]
        t = ", ".join(rnd.choice(words + ["zz"] * (rnd.random() < 0.3)) for _ in range(rnd.randint(0, 30)))
        if rnd.random() < 0.6:
            t += " " + " ".join(rnd.choice(items)[1].split()[rnd.randint(0, 3) :]) + " " + t[:20]
        auto = contamination.Automaton([(n, contamination.normalised(x.encode())) for n, x in items])
        raw = t.encode()
        n, hits = contamination._texts_hits(raw, np.array([0, len(raw)]), auto)
        spans, names = hits.get(0, ([], set()))
        assert (int(n[0]), sum(b - a for a, b in spans), sorted(names)) == contamination.brute_force(t, items)


def test_automaton_size():
    """A block of 2 MB: arrays of some 50 bytes a state, right on planted windows; long and periodic runs too."""
    rnd = random.Random(8)
    items = [(str(i), [b"w%d" % rnd.randrange(20_000) for _ in range(40)]) for i in range(8000)] + [("p", [b"a", b"b"] * 300), ("s", [b"a", b"a", b"c"])]
    auto = contamination.Automaton(items)
    arrays = sum(x.nbytes for x in vars(auto).values() if isinstance(x, np.ndarray))
    assert sum(len(w) + 1 for _, x in items for w in x) > 2_000_000 and arrays < 64 * len(auto.link)
    words = [rnd.choice(items[rnd.randrange(8000)][1]) for _ in range(3000)] + items[7][1][3:20] + [b"a", b"b"] * 2000 + [b"a", b"a", b"c"] + items[9][1]
    raw = b" ".join(words)
    n, hits = contamination._texts_hits(raw, np.array([0, len(raw)]), auto)
    assert n[0] == len(words) and hits[0][0] == [(3000, 7060)]
    assert hits[0][1] == {"7", "9", "p", "s"}


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_contamination_blocks(spark, block):
    items = [(i, " ".join(f"{c}{k}" for k in range(n))) for i, (c, n) in enumerate([("a", 20), ("b", 15), ("c", 3), ("d", 13)])] + [(None, None), (9, "")]
    docs = [(1, items[0][1].upper() + " x " + items[2][1]), (2, "y " * 500 + items[1][1]), (3, None), (4, "b1 b2 b3"), (5, "c0,C1!c2"), (6, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = contamination.find_overlaps(spark.createDataFrame(docs, DOCS), bench, block_bytes=block).orderBy("doc_id").collect()
    expected = [contamination.brute_force(t, [(str(i), x) for i, x in items]) for _, t in docs]
    assert [(r.n_words, sum(s.last - s.first for s in r.hit_spans), r.hit_items) for r in found] == expected
    left = contamination.decontaminate(spark.createDataFrame(docs, DOCS), bench)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 6]
    cut = {r.doc_id: r.text for r in contamination.cut_spans(contamination.find_overlaps(spark.createDataFrame(docs, DOCS), bench)).collect()}
    assert cut[1] == " x " and cut[5] == "" and cut[2] == "y " * 500 and cut[3] is None


def test_contamination_edges(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id bigint, text string")
    out = contamination.decontaminate(edge_docs(spark), bench)
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 3, 4, 5, 5] and out.columns == edge_docs(spark).columns
    assert contamination.find_overlaps(empty(spark), bench).count() == 0
    assert contamination.decontaminate(edge_docs(spark), bench.where("false")).count() == 9


# --- 7 ----------------------------------------------------------------------


def test_language_held_out_accuracy(spark, sf_dir):
    out = language.op7_language(spark, sf_dir).join(common.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 20 and (out.lang == out.lang_pred).mean() > 0.95
    assert out.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, "the and of with" if i % 2 else "der die das und", "en" if i % 2 else "de") for i in range(40)] + [(100, None, "en"), (101, "the", None)]
    model = language.train(spark.createDataFrame(rows, DOCS + ", lang string"))
    assert model.languages == ["de", "en"]
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language.predict(edge_docs(spark), model).collect())
    assert got[1:4] == [(1, "und"), (2, "und"), (3, "und")] and got[4] == (4, "de")
    nothing = language.train(spark.createDataFrame([], DOCS + ", lang string"))
    assert {(r.lang_pred, r.score) for r in language.predict(edge_docs(spark), nothing).collect()} == {("und", 0.0)}
    assert language.predict(empty(spark), model).count() == 0


def test_language_calibration():
    """Texts that two languages share come out near one half, others near one."""
    rng = np.random.default_rng(0)

    def text(low):
        u, n = np.unique(rng.integers(low, low + 200, 60), return_counts=True)
        return u, n / n.sum()

    rows = [("xy"[i % 2], *text(400 if rng.random() < 0.4 else 200 * (i % 2))) for i in rng.permutation(800)]
    m = language.fit(rows)

    def score(low):
        new = [text(low) for _ in range(100)]
        return language._softmax((np.array([s @ m.scores[u] for u, s in new]) + m.bias) / m.temperature)

    assert score(400).max(axis=1).mean() < 0.8
    assert score(0)[:, 0].mean() > 0.9 and score(200)[:, 1].mean() > 0.9
    assert 0.5 < m.reject_below < 1


# --- 8 ----------------------------------------------------------------------

EVENTS = "conv_id bigint, seq bigint, kind string, turn bigint, role string, text string"


def folded(spark, events):
    out = chat.read_back(chat.render(chat.fold_events(spark.createDataFrame(events, EVENTS)))).collect()
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text, r.formatted) for r in out}


def plain_fold(events):
    """The event rules, one after the other."""
    turns = {}
    for _, _, kind, turn, role, text in events:
        msgs = turns.setdefault(turn, [])
        if kind == "message" or not msgs:
            msgs.append([role or "", "" if kind == "regenerate" else text or ""])
        elif kind == "delta":
            msgs[-1][1] += text or ""
        elif kind == "edit":
            msgs[-1][1] = text or ""
        else:
            msgs[-1][1] = ""
        if kind == "regenerate":
            turns = {t: m for t, m in turns.items() if t <= turn}
    return [tuple(m) for t in sorted(turns) for m in turns[t]]


def test_chat_events(spark):
    rnd = random.Random(8)
    events = []
    for c in range(60):
        for s in range(rnd.randrange(1, 14)):
            turn = rnd.randrange(4)
            events.append((c, s, rnd.choice(["message", "delta", "delta", "edit", "regenerate"]), turn, "assistant" if turn % 2 else "user", rnd.choice(["a", "b\\", "</turn>", "<turn user>", "#", "é\n", ""])))
    got = folded(spark, rnd.sample(events, len(events)))
    for c in range(60):
        turns = plain_fold([e for e in events if e[0] == c])
        assert got[c][0] == turns
        assert got[c][1] == "".join(t for r, t in turns if r == "assistant")


def test_chat_edges(spark):
    odd = "\\### Assistant: </turn> ok"
    got = folded(spark, [(1, 0, None, 0, None, None), (1, 1, "message", 1, "assistant", odd), (2, None, "message", None, "user", "x"), (None, 0, "message", 0, "assistant", "y"), (3, 0, "message", 0, "user", "r"), (3, 0, "message", 0, "user", "r"), (4, 0, "message", 0, "user", LONG)])
    assert got[1][:2] == ([("", ""), ("assistant", odd)], odd)
    assert got[None][:2] == ([("assistant", "y")], "y") and got[3][0] == [("user", "r")] * 2 and got[4][0] == [("user", LONG)]
    assert folded(spark, []) == {}


# --- 9 ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_vocabulary()


def test_pieces_equal_the_library(vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rnd = random.Random(9)
    letters = "abcdeinorst    \n.,-=ÉéßüЖ日中😀　$%#0123<>_\x00▁"
    texts = ["", " ", "  Hello  wörld\n\tab  ", "a" * 500, "the " * 50, "-" * 80, "=" * 70 + " x", "x▁y ▁", "é" * 40, LONG[:5000]]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 200))) for _ in range(500)]
    texts += ["".join(rnd.choice(vocabulary.pieces[259:5000]).replace("▁", " ") for _ in range(60)) for _ in range(300)]
    ids, off = pieces.encode_texts(texts, vocabulary)
    expected = sp.encode(texts)
    for k, t in enumerate(texts):
        own = ids[off[k] : off[k + 1]].tolist()
        assert own == expected[k], t
        assert pieces.decode_ids(own, vocabulary) == t.replace("▁", " ")


def test_pieces_edges(spark, vocabulary):
    out = pieces.decode(pieces.encode(edge_docs(spark), vocabulary), vocabulary)
    got = sorted((r.doc_id or 0, len(r.ids), r.decoded == (r.text or "")) for r in out.collect())
    assert [g[0] for g in got] == [0, 1, 2, 3, 4, 5, 5, 6, 7] and all(g[2] for g in got) and got[1][1] == got[2][1] == 0
    assert pieces.encode(empty(spark), vocabulary).count() == 0


# --- 10 ---------------------------------------------------------------------


def plain_quality(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    again = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_quality_brute_force(spark):
    rnd = random.Random(10)
    rows = [(i, rnd.choice([" ", "\n", " \t"]).join(rnd.choice(["a", "the", "é$", "<b>", "x y"]) for _ in range(rnd.randrange(60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a\nb\n\na\n a\n"), (103, "a b c d e f g h a b c d e f g h")]
    got = {r[0]: tuple(r)[1:] for r in quality.quality_features(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {i: plain_quality(t) for i, t in rows}


def test_quality_edges(spark):
    out = quality.keep_good(edge_docs(spark))
    assert out.columns == edge_docs(spark).columns and out.count() == 0
    assert quality.keep_good(empty(spark)).count() == 0
    good = "The house stands in the old part of the town and was built by a man who came from the sea in a year that nobody knows."
    assert quality.keep_good(spark.createDataFrame([(1, good), (1, good)], DOCS)).count() == 2
