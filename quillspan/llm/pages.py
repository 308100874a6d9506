"""Main text of web pages by consensus paths.

Each page's containers are scored by the text that stands in them; the scores are
votes on the containers' generalised paths (tags and classes, without numbers),
added up for each host in Spark. The host's winning path is then used to extract
all of its pages anew; a page that lacks it goes by its own best container.

Texts meet only numbers: votes are combined in each task before the shuffle, and
the winners are sent to the tasks while they are few (a checked bound); beyond
that they are joined on the host, where Spark splits large hosts.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import bounded_batches, materialise, table, tidy

#: Hosts whose winners are sent to every task (under 20 MB); more are joined.
SENT_HOSTS = 100_000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NUMBER = re.compile(r"[0-9]+")
_WORDS = re.compile(r"[^a-z0-9]+")
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div td center".split())
#: Elements that break text into blocks.
BLOCKS = CONTAINERS | frozenset("address aside blockquote br caption dd details dialog dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr legend li menu nav ol option p pre select summary table tbody tfoot th thead tr ul".split())
TRACKED = BLOCKS - {"br", "hr"}
#: Elements that aren't main text; a header within an article is the article's own.
SKIPPED = frozenset("nav header footer aside form head menu dialog button select".split())
#: Words of class, id and role that mark what isn't main text, and words that only say where or how much of it there is.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer dialog "
    "footer header menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted recommended related reply replies search share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
PLAIN = frozenset(
    "area articles bar block body bottom box button buttons container content field form global group holder inner item items left link links list main module outer page panel "
    "posts primary right section secondary site slot text thread title top unit widgets wrap wrapper zone".split()
)
#: An opening tag of these ends an open paragraph.
_ENDS_P = BLOCKS - {"br", "html", "head", "body"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _noisy(names: str) -> bool:
    """Whether one of some names says that an element isn't main text: a word of ``NOISE``, and no other than plain ones beside it."""
    for name in names.split():
        words = [w for w in _WORDS.split(name) if w and not w.isdigit()]
        if not NOISE.isdisjoint(words) and all(w in NOISE or w in PLAIN for w in words):
            return True
    return False


class Page:
    """One reading of a page: the texts of its blocks with the containers that they stand in.

    ``paths`` names every container (its place in ``parents``, a generalised path);
    ``texts`` has (container, text, within a link) in page order; None is a block's end.
    """

    def __init__(self, source: str):
        self.paths, self.parents = [""], [-1]
        self.texts: list[tuple[int, str, bool] | None] = []
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, container, skipped, within an article
        link, at, put = 0, 0, self.texts.append
        lower = None
        for m in _TAG.finditer(source):
            start = m.start()
            if start < at:
                continue  # inside what was passed over as raw content
            if start > at and not stack[-1][2]:
                put((stack[-1][1], source[at:start], link > 0))
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "a":
                    link = max(0, link - 1)
                block = tag in TRACKED
                if block:
                    put(None)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                    if not block and stack[i][0] in TRACKED:
                        break  # the end of an inline element ends no block
                continue
            if tag in RAW:
                lower = lower if lower is not None else _lowered(source)
                end = lower.find(f"</{tag}", at)
                at = len(source) if end < 0 else source.find(">", end) + 1 or len(source)
                continue
            if tag == "a":
                link = 1  # links don't nest
            block = tag in BLOCKS
            names, noisy = [], tag in SKIPPED
            if m[3] and tag not in VOID:
                for key, a, b, c in _ATTRIBUTE.findall(m[3]):
                    value = (a or b or c).lower()
                    noisy = noisy or (tag not in ("html", "body") and _noisy(value))
                    if key.lower() == "class":
                        names += sorted(_NUMBER.sub("#", x) for x in value.split())
            if not block:
                if noisy and tag not in VOID:
                    stack.append((tag, stack[-1][1], True, stack[-1][3]))
                continue
            put(None)
            if tag not in TRACKED or m[3].endswith("/") and tag in VOID:
                continue
            while stack[-1][0] not in TRACKED and len(stack) > 1:
                stack.pop()  # a block ends what is open of inline elements
            if tag in _ENDS_P and stack[-1][0] == "p":
                stack.pop()
            if tag in _SAME and stack[-1][0] in _SAME[tag]:
                stack.pop()
            _, box, skipped, article = stack[-1]
            skipped = skipped or noisy and not (tag == "header" and article)
            # sections of an article, and what has no name in it, are the article itself
            if tag in CONTAINERS and not (article and (tag == "section" or tag == "div" and not names)):
                self.paths.append(f"{self.paths[box]}/{'.'.join([tag, *names])}")
                self.parents.append(box)
                box = len(self.paths) - 1
            stack.append((tag, box, skipped, article or tag == "article"))
        if at < len(source) and not stack[-1][2]:
            put((stack[-1][1], source[at:], link > 0))

    def scores(self) -> dict[str, int]:
        """Votes by path: characters outside links, two for the container itself and one for the one around it."""
        size = [0] * len(self.paths)
        for t in self.texts:
            if t and not t[2]:
                n = len(t[1].strip())
                size[t[0]] += 2 * n
                if self.parents[t[0]] >= 0:
                    size[self.parents[t[0]]] += n
        out: dict[str, int] = defaultdict(int)
        for p, n in zip(self.paths, size, strict=True):
            if n:
                out[p] += n
        return out

    def text(self, path: str | None) -> str:
        """Text inside all containers at ``path``, or at the page's own best one where it has none."""
        if path is None or path not in self.paths:
            scores = self.scores()
            path = max(scores, key=lambda p: (scores[p], p)) if scores else ""
        inside = [False] * len(self.paths)
        for i, p in enumerate(self.paths):
            inside[i] = p == path or self.parents[i] >= 0 and inside[self.parents[i]]
        # a reference is one within a text, not over the tags between two
        raw = "".join("\n" if t is None else html.unescape(t[1]) if inside[t[0]] else "" for t in self.texts)
        return " ".join(raw.split())


def _lowered(s: str) -> str:
    """Lower case of ASCII letters only, so that places stay."""
    return s.translate(_LOWER)


_LOWER = {i: i + 32 for i in range(65, 91)}


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        votes: dict[tuple[str, str], int] = defaultdict(int)
        for host, source in zip(b.column("host"), b.column("html"), strict=True):
            h = host.as_py()
            for path, n in Page(source.as_py()).scores().items():
                votes[h, path] += n
        if votes:
            h, p = zip(*votes, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(p, pa.string()), pa.array(list(votes.values()), pa.int64())], ["host", "path", "votes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [Page(source.as_py()).text(path.as_py()) for source, path in zip(b.column("html"), b.column("path"), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def _prepared(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, votes: each host's winning path; of equal votes the last path by name. Pages without a url share the empty host."""
    votes = _prepared(pages).select("host", "html").mapInArrow(tidy(_vote), "host string, path string, votes bigint").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    best = votes.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("b"))
    return best.select("host", F.col("b.path").alias("path"), F.col("b.votes").alias("votes"))


def extract_main_text(pages: DataFrame, sent_hosts: int = SENT_HOSTS) -> DataFrame:
    """page_id, url, text: the main text of every row, whole.

    Null and empty pages, and pages without main text, give an empty text. A row
    comes back for each row, repeated ones too; an empty table gives an empty one.
    Of the columns only page_id, url and html are read.
    """
    bounded_batches(pages.sparkSession)
    winners = materialise(host_paths(pages).select("host", "path"), "host-paths")
    few = winners.count() <= sent_hosts
    rows = _prepared(pages).join(F.broadcast(winners) if few else winners, "host", "left")
    return rows.select("page_id", "url", "html", "path").mapInArrow(tidy(_extract), "page_id bigint, url string, text string")


def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(table(spark, sf_dir, "pages").withColumn("page_id", F.col("page_id").cast("bigint")))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
