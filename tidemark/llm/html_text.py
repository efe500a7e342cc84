"""Main text of web pages by templates deduced from equivalence classes of tokens.

The tokens of a page are its opening tags with their class, id and role. Two tokens of a host are equivalent if their
occurrence vectors (how often each page of the host has them) are equal. Vectors are compared by fingerprints that add
up over pages, so a host with any number of pages is an aggregation with map-side partials, never a group in one task.
Classes with enough tokens and pages are valid; the class that most pages have once is the template's root, and the
others nest in its elements and in each other's. A page that has a class's tokens in another order does not keep it and
takes no main slot from it; whether a slot is constant does not depend on the order.

A slot is what an element holds outside the elements with slots within it. If the slot of a class's token has one text
on all pages that have it, while these pages differ, it is the template's and is dropped. The other slots are the
page's own content. Which of them hold the main text is read from the template: the article or main element of the
classes that their pages have once, else the innermost of their elements that holds most of the text of its pages. A
page that keeps none of these classes is read by its own elements.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written
from .url_filters import url_parts

#: Pages a class must occur on, and tokens it must have, to be valid.
MIN_PAGES, MIN_TOKENS = 3, 3
#: Share of a host's text that an element must hold to be the main one where none is named as such.
MOST_TEXT = 0.6

_RAW = "script|style|noscript|template|textarea|iframe|xmp|noembed|title"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<close2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*+)>|<[!?][^>]*+>",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that have a slot of their own only if a class, id or role marks them: they hold a sentence or two of a text.
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr pre blockquote option caption figcaption legend summary center address".split())
#: Elements whose ids are anchors made from their headings.
_ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 section".split())
#: Elements, and words of class, role or id, that are not the main text. A name of several words counts if the
#: others are NEUTRAL: "cookie-bar" does, "search-story" and "article-header" do not.
_OTHER = frozenset("nav header footer aside form head button select dialog menu datalist".split())
_OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead complementary contentinfo comment comments reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe signup login popup modal overlay search".split()
)
_OTHER_NAMES = frozenset("user-reviews customer-reviews reader-reviews".split())
_NEUTRAL = frozenset(
    "area bar block bottom box btn button buttons center col column content contents container form global group head icon icons inner input item items js label left link links list main module outer page panel posts primary right row secondary section site slot sticky strip text the title top unit user users reader readers widget widgets wp wrap wrapper".split()
)


_TEASER, _COMMENTS = re.compile(r"\[.*(teaser|related|recommended|promo)"), re.compile(r"\[.*(comment|repl(y|ies))")


def joined(runs: Iterable[tuple[str, int]]) -> str:
    """One line of the runs' text."""
    return " ".join("".join(x for x, _ in runs).split())


class Page:
    """One pass over a page: its token keys in order, the token around each, and the blocks of text as runs with the
    innermost token around. All that follows walks the tokens once, parents before children: time is linear in the page."""

    def __init__(self, source: str):
        self.keys: list[str] = []
        self.parent: list[int] = []  # for each token, the one around it, or -1
        self.blocks: list[list[tuple[str, int]]] = []  # of each block its runs of text and the tokens around, or -1
        self.other: list[bool] = []
        self.header: list[bool] = []  # other, but as a header only, which within an article is the article's own
        self.controls: list[int] = []  # what a reader fills in or presses
        self._parse(source)
        self._judge_forms()
        self.dead: list[bool] = []  # within an element that is no main text
        self.owners: list[int] = []  # the innermost element around, or the token's own, that has a slot; -1
        for i, up in enumerate(self.parent):
            tag, marked = self.keys[i].partition("[")[::2]
            self.dead.append(self.other[i] or up >= 0 and self.dead[up])
            self.owners.append(i if tag in _BLOCK and (marked or tag not in _PLAIN) else self.owners[up] if up >= 0 else -1)

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = []
        open_: Counter = Counter()
        runs: list[tuple[str, int]] = []
        around = -1

        def flush() -> None:
            nonlocal runs
            if any(not x.isspace() for x, _ in runs):
                self.blocks.append(runs)
            runs = []

        def add(x: str) -> None:
            if x:
                runs.append((html.unescape(x), around))

        def pop() -> None:
            open_[stack.pop()[0]] -= 1

        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                add(source[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag is None:
                continue
            tag = tag.lower()
            block = tag in _BLOCK
            if block:
                flush()
            if m["close"] or m["close2"]:
                if open_[tag]:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            while len(stack) > i:
                                pop()
                            break
                        if tag == "p" and stack[i][0] in _BLOCK or not block and stack[i][0] in _BLOCK:
                            break  # a stray closing tag closes nothing beyond its block
            else:
                attrs = m["attrs"] or m["attrs2"] or ""
                key, other, header = self._key(tag, attrs)
                number = len(self.keys)
                self.keys.append(key)
                self.other.append(other)
                self.header.append(header)
                if tag in ("button", "select") or tag == "input" and "hidden" not in attrs.lower():
                    self.controls.append(number)
                if block and tag != "br":  # an open paragraph, and an item or cell of the same kind, ends here
                    while stack and (stack[-1][0] == "p" or stack[-1][0] not in _BLOCK and open_["p"] and self._in_p(stack)):
                        pop()
                    if stack and stack[-1][0] == tag and tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                        pop()
                self.parent.append(stack[-1][1] if stack else -1)
                if tag not in _VOID and not attrs.rstrip().endswith("/"):
                    stack.append((tag, number))
                    open_[tag] += 1
            around = stack[-1][1] if stack else -1
        if at < len(source):
            rest = source[at:]
            cut = re.search(r"<[a-z/!?][^>]*\Z", rest, re.IGNORECASE)  # a tag that the page's end cuts
            add(rest[: cut.start()] if cut else rest)
        flush()

    @staticmethod
    def _in_p(stack: list[tuple[str, int]]) -> bool:
        """Whether only inline elements stand between the top of the stack and an open paragraph."""
        for tag, _ in reversed(stack):
            if tag == "p":
                return True
            if tag in _BLOCK:
                return False
        return False

    @staticmethod
    def _key(tag: str, attrs: str) -> tuple[str, bool, bool]:
        """Token key, whether the element is no main text, and whether that is only because it is a header."""
        if not attrs or "=" not in attrs:
            return tag, tag in _OTHER, tag == "header"
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").strip().lower() for m in _ATTRIBUTE.finditer(attrs)}
        why = {tag} & _OTHER
        for name in " ".join(v for k, v in found.items() if k != "id" or tag not in _ANCHORED).split():
            words = _WORD.findall(name)
            if "-".join(words) in _OTHER_NAMES:
                why |= {"reviews"}
            elif _OTHER_WORDS.intersection(words) and _NEUTRAL.union(_OTHER_WORDS).issuperset(words):
                why |= _OTHER_WORDS.intersection(words)
        key = tag + "".join(f"[{k}={v}]" for k, v in sorted(found.items()) if v)
        return key, bool(why), why == {"header"}

    def _sums(self, of: list[int]) -> list[int]:
        """Of each token, the sum over it and all tokens within."""
        out = list(of)
        for i in range(len(out) - 1, -1, -1):
            if self.parent[i] >= 0:
                out[self.parent[i]] += out[i]
        return out

    def _judge_forms(self) -> None:
        """A form around an article, or around more prose than its controls account for, is a wrapper of the page."""
        forms = [i for i, k in enumerate(self.keys) if self.other[i] and (k == "form" or k.startswith("form[")) and not self._key("div", re.sub(r"\[(\w+)=(.*?)\](?=\[|$)", r' \1="\2"', k[4:]))[1]]
        if not forms:
            return
        prose, controls, mains = ([0] * len(self.keys) for _ in range(3))
        for block in self.blocks:
            if block[0][1] >= 0 and (n := len(joined(block))) >= 60:
                prose[block[0][1]] += n
        for i in self.controls:
            controls[i] += 1
        for i, k in enumerate(self.keys):
            mains[i] = int(self.main_rank(i) < 9 or k == "h1" or k.startswith("h1["))
        prose, controls, mains = self._sums(prose), self._sums(controls), self._sums(mains)
        for i in forms:
            if mains[i] or prose[i] >= 100 * (controls[i] + 1):
                self.other[i] = False

    def _lists_of_links(self) -> list[bool]:
        """Whether each token lies in a block of three or more short links that hold four fifths of its text."""
        chars, linked, links, inside = [0] * len(self.keys), [0] * len(self.keys), [0] * len(self.keys), []
        for i, k in enumerate(self.keys):
            a = k == "a" or k.startswith("a[")
            links[i] = int(a)
            inside.append(a or self.parent[i] >= 0 and inside[self.parent[i]])
        for text, i in (run for block in self.blocks for run in block):
            if i >= 0:
                n = sum(map(len, text.split()))
                chars[i] += n
                linked[i] += n * inside[i]
        chars, linked, links = self._sums(chars), self._sums(linked), self._sums(links)
        out: list[bool] = []
        for i, up in enumerate(self.parent):
            tag = self.keys[i].partition("[")[0]
            dense = tag in _BLOCK and tag not in ("html", "body", "article", "main") and links[i] >= 3 and 5 * linked[i] >= 4 * chars[i] and linked[i] <= 50 * links[i]
            out.append(dense or up >= 0 and out[up])
        return out

    def main_rank(self, i: int) -> int:
        """How surely token i is the main element: 0 by article or body of an article, 1 main, 9 no sign."""
        tag = self.keys[i].split("[", 1)[0]
        words = set(_WORD.findall(self.keys[i].split("[", 1)[1])) if "[" in self.keys[i] else set()
        if tag == "article" or words & {"articlebody", "article"}:
            return 0
        return 1 if tag == "main" or "main" in words else 9

    def below(self) -> tuple[list[int], int]:
        """Characters of text below each token, and of the page, outside other elements; white space does not count."""
        out, total = [0] * len(self.keys), 0
        for text, i in (run for block in self.blocks for run in block):
            if i < 0 or not self.dead[i]:
                n = sum(map(len, text.split()))
                total += n
                if i >= 0:
                    out[i] += n
        for i in range(len(out) - 1, -1, -1):
            if self.parent[i] >= 0:
                out[self.parent[i]] += out[i]
        return out, total

    def slot_texts(self) -> dict[str, str]:
        """Token: the text of its slots."""
        out: dict[str, list[str]] = {}
        for block in self.blocks:
            i = block[0][1]  # no block element begins or ends within a block of text
            if i >= 0 and self.owners[i] >= 0:
                out.setdefault(self.keys[self.owners[i]], []).append(joined(block))
        return {k: "\n".join(x) for k, x in out.items()}

    def _named_mains(self, even_dead: bool = False) -> list[int]:
        """Where no template tells: the elements of the surest main rank, but for teasers beside others; with ``even_dead`` those
        within elements that are no main text by name too, but for comments."""
        ranks = {i: r for i, k in enumerate(self.keys) if (r := self.main_rank(i)) < 9 and (not self.dead[i] or even_dead and not _COMMENTS.search(k))}
        mains = [i for i, r in ranks.items() if r == min(ranks.values())]
        return [i for i in mains if not _TEASER.search(self.keys[i])] or mains

    def text(self, slots: list[dict] | None, constant: list[str] | None = None) -> str:
        """The blocks of the main slots. ``slots``: the host's; the first whose template the page keeps counts.

        ``constant``: the tokens whose slots are the template's. The main slot is never one of them.
        """
        mains: list[int] = []
        for slot in slots or ():
            known = set(slot["template"])
            if [k for k in self.keys if k in known] == slot["template"]:
                mains = [self.keys.index(slot["region"])]
                break
        wanted = set(mains or self._named_mains())
        out = self._kept(wanted, self._stays(wanted), set(constant or ()))
        if not out and (named := set(self._named_mains(even_dead=True))):  # names alone don't empty a page that has an article
            out = self._kept(named, self._stays(named, even_dead=True), set())
        return "\n".join(out)

    def _kept(self, wanted: set[int], stays: list[bool], constant: set[str]) -> list[str]:
        dropped = constant - {self.keys[i] for i in wanted}
        out = []
        for block in self.blocks:
            own = self.owners[block[0][1]] if block[0][1] >= 0 else -1
            if dropped and own >= 0 and self.keys[own] in dropped:
                continue
            text = joined(run for run in block if (stays[run[1]] if run[1] >= 0 else not wanted))
            if text:
                out.append(text)
        return out

    def _stays(self, wanted: set[int], even_dead: bool = False) -> list[bool]:
        """Whether the text directly in each token is of the main slots (outside other elements and lists of links if there are none)."""
        if not wanted:
            return [not (x or y) for x, y in zip(self.dead, self._lists_of_links())]
        main: list[int] = []  # the outermost wanted token around, or the token itself
        out: list[bool] = []
        for i, up in enumerate(self.parent):
            if up >= 0 and main[up] >= 0:
                main.append(main[up])
                # The header of an article holds its title, unless the main slot is the page itself; other parts are no main text.
                own = self.keys[main[up]].partition("[")[0] not in ("html", "body")
                out.append(out[up] and not (self.other[i] and not (own and self.header[i])))
            else:
                main.append(i if i in wanted else -1)
                out.append(i in wanted and (even_dead or not (up >= 0 and self.dead[up])))
        return out


def _digest(text: str) -> int:
    """64 bits of a text; 0 for none."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) if text else 0


def token_vectors(pages: DataFrame) -> DataFrame:
    """host, token, and of its occurrence vector: fingerprint, pages, least and greatest count; and order, text below, text of its pages; and
    whether its slot is constant: one text on all its pages, of which MIN_PAGES or more differ.

    ``pages`` has host, page_id and html. A page's share of the fingerprint is a hash of the page and the count.
    """
    schema = "host string, page_id long, token string, n int, place double, below long, total long, slot long, whole long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[] for _ in range(9)]
            for host, page, source in zip(*(c.to_pylist() for c in batch.columns)):
                p = Page(source or "")
                (each, total), seen = p.below(), Counter(p.keys)
                first = {k: i for i, k in reversed(list(enumerate(p.keys)))}
                below: Counter = Counter()
                for i, k in enumerate(p.keys):
                    below[k] += each[i]
                slots = {k: _digest(x) for k, x in p.slot_texts().items()}
                whole = _digest("\n".join(map(joined, p.blocks)))
                for k, n in seen.items():
                    for column, x in zip(rows, (host, page, k, n, first[k] / len(p.keys), below[k], total, slots.get(k, 0), whole)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "page_id", "token", "n", "place", "below", "total", "slot", "whole"])

    counted = pages.select("host", "page_id", "html").mapInArrow(run, schema)
    share = F.xxhash64("page_id", "n").bitwiseAND(F.lit((1 << 40) - 1))
    # Pages of one text first, so that different texts are counted exactly.
    alike = counted.groupBy("host", "token", "whole").agg(
        F.sum(share.cast("decimal(38,0)")).alias("vector"), F.count(F.lit(1)).alias("pages"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("place").alias("places"), F.sum("below").alias("below"), F.sum("total").alias("total"), F.min("slot").alias("a"), F.max("slot").alias("b"),
    )
    constant = (F.min("a") == F.max("b")) & (F.min("a") != 0) & (F.count(F.lit(1)) >= MIN_PAGES)
    return alike.groupBy("host", "token").agg(
        F.sum("vector").alias("vector"), F.sum("pages").alias("pages"), F.min("least").alias("least"), F.max("most").alias("most"), (F.sum("places") / F.sum("pages")).alias("place"), F.sum("below").alias("below"), F.sum("total").alias("total"), constant.alias("constant"),
    )


def equivalence_classes(vectors: DataFrame) -> DataFrame:
    """host, vector, pages, tokens (in order), once, root: the valid classes, of MIN_TOKENS tokens on MIN_PAGES pages at least.

    The root is the class of the most pages among those that each of their pages has once: odd pages don't take it away.
    """
    classes = vectors.filter(F.col("pages") >= MIN_PAGES).groupBy("host", "vector", "pages").agg(F.array_sort(F.collect_list(F.struct("place", "token", "below", "total", "constant"))).alias("tokens"), F.min("least").alias("least"), F.max("most").alias("most"))
    classes = written(classes.filter(F.size("tokens") >= MIN_TOKENS).withColumn("once", F.col("most") == 1), "classes")
    roots = classes.filter("once").groupBy("host").agg(F.max_by("vector", F.struct("pages", F.size("tokens"), "vector")).alias("root"))
    return classes.join(roots, "host", "left").select("host", "vector", "pages", "tokens", "once", F.coalesce(F.col("vector") == F.col("root"), F.lit(False)).alias("root"))


def templates(pages: DataFrame) -> DataFrame:
    """host, region (the token of the main slot), slots, constant (the tokens of all classes whose slots are the template's).

    ``slots`` are (region, template: the tokens of its class in order) in the order in which a page takes the first whose
    template it keeps: named main slots before others, those of more pages first; of others the inner ones first.
    They are as long as a page for each class that has a main slot.
    """
    classes = written(equivalence_classes(written(token_vectors(pages), "token-vectors")), "nested")
    found = classes.filter("once")
    named = F.filter("tokens", lambda t: t["token"].rlike(r"^(article(\[|$)|[a-z0-9]+\[.*(articlebody|article\b))") & ~t["token"].rlike("comment|related|teaser"))
    main = F.filter("tokens", lambda t: t["token"].rlike(r"^main(\[|$)|\[role=main\]"))
    # Else the last element in page order, so the innermost, that holds most of the text of the pages that have it.
    most = F.filter("tokens", lambda t: (t["below"] >= MOST_TEXT * t["total"]) & ~t["token"].rlike("^(html|head)"))
    region = F.coalesce(F.get(named, F.lit(0)), F.get(main, F.lit(0)), F.try_element_at(most, F.lit(-1)))
    rank = F.when(F.size(named) > 0, 0).when(F.size(main) > 0, 1).otherwise(2)
    of_class = found.withColumn("region", region).withColumn("rank", rank).filter("region is not null")
    order = F.struct("rank", F.when(F.col("rank") < 2, -F.col("pages")).otherwise(-F.col("region.place")).alias("order"), F.col("region.token").alias("region"), F.transform("tokens", lambda t: t["token"]).alias("template"))
    slots = of_class.groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("slots"))
    constant = classes.select("host", F.explode(F.filter("tokens", lambda t: t["constant"])).alias("t")).groupBy("host").agg(F.sort_array(F.collect_list("t.token")).alias("constant"))
    return slots.join(constant, "host", "full").select("host", "constant", F.get("slots", F.lit(0))["region"].alias("region"), F.transform("slots", lambda s: F.struct(s["region"].alias("region"), s["template"].alias("template"))).alias("slots"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text: blocks of the main slots in page order, one a line, white space within a block as one space.

    Null or empty html, and pages without main text, give an empty text; a null URL belongs to the host without a
    name; repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    host, _ = url_parts(F.col(url_col))
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    found = written(templates(named), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [Page(source).text(slots, constant) if source else "" for source, slots, constant in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], names=["page_id", "url", "text"])

    # Templates are as many as hosts. Spark broadcasts them if the written table is small, else splits hot hosts of the join.
    return named.join(found, "host", "left").select("page_id", "url", "html", "slots", "constant").mapInArrow(run, "page_id long, url string, text string")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
