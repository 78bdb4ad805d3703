"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks: the text between block-level tags, with the tags, classes, ids and roles of the open elements around it. Every
block has features of its ancestors, of its text, of its place and of the block before. The field scores the sequence of labels (main text or not);
Viterbi gives the best one and the main blocks are joined.

Training: the tables hold no marked pages, so the labels come from pages that mark themselves: blocks inside ``article`` or ``main`` are main text
unless they also stand in an element for menus, notices, adverts, comments and the like; everything else is not. At most about ``sample`` such pages are used
(a bounded sample chosen by hash). Each is used as it is, and again in a disguise: ``article`` becomes a neutral or speaking ``div``, the other parts get
other tags and names, and typical side blocks are put before, after and into the article. So the field learns names and text as well as the tag.
The weights are fitted by stochastic gradients of the log-likelihood (forward and backward sums).

Null and empty html, and pages without main blocks, give an empty text. Repeated rows are extracted one by one. Broken markup is read as far as it goes: unclosed and
stray tags, cut character references and cut tags. Elements without text of their own (``select``, ``object``, ``svg`` and the like) are quiet up to their end, or that of the
element around them; one that is never closed on the page is passed over and what follows is read. Only raw text (``script``, ``style``, ``title``, ``textarea``, ``iframe``) runs to the
end of the page when it is not closed. Formulas keep their text. Pages of any length are read whole, other columns stay. Cue words are looked for in
blocks of up to 40 words; longer ones are judged by their other features.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_markup = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_attribute = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_name = re.compile(r"[a-z]+")
# Fixed values of HTML.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul button textarea".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe".split())
QUIET = set("template noscript svg object select canvas audio video annotation annotation-xml".split())
LEAVES = {"svg", "select"}  # block-level tags cannot stand in them and end them
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
#: Names that side parts of pages bear, by the part; used to disguise training pages and to tell what inside an article is not the article.
SIDE = {
    "nav": ["menu", "nav", "navigation", "navbar", "breadcrumb", "breadcrumbs", "pagination", "toc"], "header": ["header", "masthead", "topbar", "banner", "toolbar", "logo"], "footer": ["footer", "foot", "bottom", "copyright", "legal"],
    "aside": ["sidebar", "side", "widget", "related", "recommended", "share", "social", "promo", "tags"], "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promoted"],
    "notice": ["cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "gdpr", "banner"], "form": ["form", "newsletter", "subscribe", "signup", "login", "search"], "comments": ["comments", "comment", "replies", "reply", "discussion", "respond", "thread"],
}
MAIN = ["content", "article", "main", "post", "entry", "story", "body", "text", "page"]
SIDE_TAGS = {"nav", "header", "footer", "aside", "form", "dialog", "button", "menu"}
SIDE_NAMES = {n for names in SIDE.values() for n in names} - {"body", "text", "thread", "side", "bottom", "tags"}
SAID = {"nav": ["Home", "About us", "Contact"], "header": ["Welcome"], "footer": ["© 2024 All rights reserved.", "Privacy policy · Terms"], "aside": ["Related articles", "Most read"], "ad": ["Advertisement", "Buy now and save"],
        "notice": ["We use cookies to improve this site.", "Accept all"], "form": ["Subscribe to our newsletter", "Your e-mail"], "comments": ["3 comments", "Reply"]}

Block = tuple[tuple[str, ...], str, float]  # tokens of the ancestors from the outside in, text, share of it in links


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = total = 0
    in_link = 0
    quiet = -1  # level of the outermost open element that is quiet
    last_end: dict[str, int] = {}  # where the last end of a tag stands

    def flush() -> None:
        nonlocal linked, total
        body = " ".join("".join(text).split())
        if body:
            out.append((tuple(t for _, tokens in stack if tokens for t in tokens), body, linked / max(1, total)))
        text.clear()
        linked = total = 0

    def add(raw: str) -> None:
        nonlocal linked, total
        if quiet >= 0:
            return
        s = html.unescape(raw) if "&" in raw else raw
        text.append(s)
        n = len(s.strip())
        total += n
        if in_link:
            linked += n

    def pop(to: int) -> None:
        nonlocal in_link, quiet
        while len(stack) > to:
            if stack.pop()[0] == "a":
                in_link -= 1
        if quiet >= to:
            quiet = -1

    def ends_after(tag: str, at: int) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}(?![^\s/>])", page, re.I)), default=-1)
        return last_end[tag] >= at

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        m = _markup.match(page, lt)
        if m is None:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, rest = (m[1], m[3]) if m[2] else (m[4], m[6])
        if closing:
            level = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if 0 <= quiet and (level < 0 or level >= quiet or tag not in BLOCKS):
                if level >= quiet:
                    pop(level)
                continue
            if tag in BLOCKS:
                flush()
            if level >= 0 and (tag in BLOCKS or not any(t in BLOCKS for t, _ in stack[level + 1:])):
                pop(level)
            continue
        if tag in RAW:
            if tag in BLOCKS and quiet < 0:
                flush()
            if not rest.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if quiet >= 0:
            if not (stack[quiet][0] in LEAVES and tag in BLOCKS and tag not in ("hr", "option")):
                if tag not in VOID and not rest.rstrip().endswith("/"):
                    stack.append((tag, ()))
                    in_link += tag == "a"
                continue
            pop(quiet)
        if tag in QUIET:
            if tag in BLOCKS:
                flush()
            if not rest.rstrip().endswith("/") and ends_after(tag, at):
                quiet = len(stack)
                stack.append((tag, ()))
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES:
                gone, border = CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in border:
                        break
                    if stack[i][0] in gone:
                        pop(i)
                        break
            level = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS), -1)
            if level >= 0 and stack[level][0] == "p":
                pop(level)
        elif tag == "br":
            text.append(" ")
        if tag not in VOID:
            if tag in ("html", "body"):  # around everything, so they tell nothing
                stack.append((tag, ()))
                continue
            names = tuple(f"n:{n}" for _, v in _attribute.findall(rest) for n in _name.findall(v.lower())) if rest else ()
            stack.append((tag, (f"t:{tag}", *names) if tag in BLOCKS or names else ()))
            in_link += tag == "a"
    flush()
    return out


def _text_features(body: str, linked: float) -> list[str]:
    n = body.count(" ") + 1
    low = body.lower() if n <= 40 else ""
    """Of the text itself; weak signs, since an article may hold any text."""
    f = [f"words:{min(7, n.bit_length())}", f"link:{round(linked * 4)}", f"end:{body[-1] if body[-1] in '.!?:,' else 'x'}", f"commas:{min(3, body.count(','))}"]
    if "©" in body:
        f.append("copyright")
    if low:
        f.extend(f"w:{w}" for w in set(_name.findall(low)) & _CUES)
    return f


_CUES = set("privacy terms cookie cookies accept subscribe newsletter login sign comment comments reply related share advertisement sponsored home contact about menu search read buy".split())


def labels_of(page_blocks: list[Block]) -> list[int] | None:
    """1 for main text, by the page's own marks; None if it has none."""
    if not any("t:article" in a or "t:main" in a for a, _, _ in page_blocks):
        return None
    return [int(("t:article" in a or "t:main" in a) and not _side(a)) for a, _, _ in page_blocks]


def _side(path: tuple[str, ...]) -> bool:
    return any(t[2:] in (SIDE_TAGS if t[0] == "t" else SIDE_NAMES) for t in path)


class Field:
    """Weights of the features for "main text" against "not", and of the transitions between the labels."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.move = np.zeros((2, 2))
        self.paths: dict[tuple[str, ...], float] = {}

    def observed(self, page_blocks: list[Block]) -> list[list[str]]:
        out = []
        for i, (path, body, linked) in enumerate(page_blocks):
            before = page_blocks[i - 1][0] if i else ()
            out.append([*_text_features(body, linked), "same" if path == before else "other", "first" if i == 0 else "last" if i == len(page_blocks) - 1 else "inner"])
        return out

    def path_score(self, path: tuple[str, ...]) -> float:
        s = self.paths.get(path)
        if s is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            s = self.paths[path] = sum(self.weight.get(t, 0.0) for t in {*path, "last" + path[-1] if path else "bare"})
        return s

    def decode(self, page_blocks: list[Block]) -> list[int]:
        """The best sequence of labels."""
        w = self.weight
        (a, b), (c, d) = self.move.tolist()
        zero, one, back = 0.0, 0.0, []
        for i, (feats, (path, _, _)) in enumerate(zip(self.observed(page_blocks), page_blocks)):
            e = sum([w.get(f, 0.0) for f in feats]) + self.path_score(path)
            if i == 0:
                zero, one = 0.0, e
                continue
            back.append((0 if zero + a >= one + c else 1, 0 if zero + b > one + d else 1))
            zero, one = max(zero + a, one + c), max(zero + b, one + d) + e
        y = [int(one > zero)]
        for p in reversed(back):
            y.append(p[y[-1]])
        return y[::-1]

    def extract(self, page: str) -> str:
        found = blocks(page)
        return "\n".join(body for (_, body, _), y in zip(found, self.decode(found)) if y) if found else ""


def disguise(page_blocks: list[Block], y: list[int], rng: random.Random, said: list[str]) -> tuple[list[Block], list[int]]:
    """The page in other clothes: other tags and names for its parts, more side blocks before, inside and after."""
    main = rng.choice([("t:div",), ("t:div", "n:" + rng.choice(MAIN)), ("t:section", "n:" + rng.choice(MAIN)), ("t:main",), ("t:article",), ("t:article", "n:" + rng.choice(MAIN)), ("t:td",)])
    renamed: dict[str, tuple[str, ...]] = {}

    def side(part: str) -> tuple[str, ...]:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(part, "div")
        return ("t:" + tag,) if rng.random() < 0.3 and part not in ("ad", "notice", "comments") else ("t:" + rng.choice(["div", "section", tag]), "n:" + rng.choice(SIDE[part]))

    def clothe(path: tuple[str, ...], label: int) -> tuple[str, ...]:
        out: list[str] = []
        for t in path:
            if t in ("t:article", "t:main"):
                out.extend(main)
            elif not label and (t[2:] in SIDE or t == "n:ad"):
                if t not in renamed:
                    renamed[t] = side(t[2:])
                out.extend(renamed[t])
            else:
                out.append(t)
        return tuple(out)

    rows = [((clothe(p, l), b, k), l) for (p, b, k), l in zip(page_blocks, y)]
    # An article may say such things too: what counts is the place.
    for _ in range(2):
        own = [i for i, (_, l) in enumerate(rows) if l]
        if own:
            at = rng.choice(own)
            rows.insert(at + 1, ((rows[at][0][0], rng.choice(SAID[rng.choice(list(SAID))]), 0.0), 1))
    places = [0, len(rows)]
    inside = [i for i, (_, l) in enumerate(rows) if l]
    if inside:
        places += [inside[-1] + 1, rng.choice(inside) + 1]
    for at in sorted(places, reverse=True):
        if rng.random() < 0.6:
            part = rng.choice(list(SIDE))
            around = (*(main if inside and inside[0] < at <= inside[-1] + 1 and rng.random() < 0.7 else ()), *side(part))
            if part == "comments" or rng.random() < 0.3:
                texts = [rng.choice(said) for _ in range(rng.randint(1, 4))]
            else:
                texts = SAID[part][: rng.randint(1, 3)]
            rows[at:at] = [((around + (("t:p",) if rng.random() < 0.5 else ()), t, 1.0 if part == "nav" else 0.0), 0) for t in texts]
    return [r for r, _ in rows], [l for _, l in rows]


def train(pages: list[str], epochs: int = 6, copies: int = 3, rate: float = 0.3) -> Field:
    """Fits the field to pages that mark their main text; pages without marks teach nothing."""
    rng, known = random.Random(7), []
    for p in pages:
        found = blocks(p)
        y = labels_of(found)
        if y is not None:
            known.append((found, y))
    said = [b for found, _ in known for _, b, _ in found if len(b) > 30][:5000] or ["I do not agree with this at all."]
    data = [page for page in known] + [disguise(*page, rng, said) for page in known for _ in range(copies)]
    field = Field()
    squares: dict[str, float] = {}
    move_squares = np.full((2, 2), 1e-6)
    for _ in range(epochs):
        rng.shuffle(data)
        for found, y in data:
            feats = [[*f, *{*p, "last" + p[-1] if p else "bare"}] for f, (p, _, _) in zip(field.observed(found), found)]
            scores = np.array([[0.0, sum(field.weight.get(x, 0.0) for x in f)] for f in feats])
            n, (ahead, behind) = len(y), (np.zeros((len(y), 2)), np.zeros((len(y), 2)))
            ahead[0] = scores[0]
            for i in range(1, n):
                ahead[i] = np.logaddexp(ahead[i - 1, 0] + field.move[0], ahead[i - 1, 1] + field.move[1]) + scores[i]
            for i in range(n - 2, -1, -1):
                nxt = field.move + scores[i + 1] + behind[i + 1]
                behind[i] = np.logaddexp(nxt[:, 0], nxt[:, 1])
            total = np.logaddexp(*ahead[-1])
            one = np.exp(ahead[:, 1] + behind[:, 1] - total)
            for f, p, label in zip(feats, one.tolist(), y):
                g = label - p
                if abs(g) > 1e-4:
                    for x in f:
                        squares[x] = squares.get(x, 1e-6) + g * g
                        field.weight[x] = field.weight.get(x, 0.0) * (1 - 1e-5) + rate * g / squares[x] ** 0.5
            if n > 1:
                joint = np.exp(ahead[:-1, :, None] + field.move + (scores + behind)[1:, None, :] - total)
                grad = -joint.sum(0)
                np.add.at(grad, (y[:-1], y[1:]), 1)
                move_squares += grad**2
                field.move += rate * grad / np.sqrt(move_squares)
    return field


def fit(pages: DataFrame, sample: int = 300, column: str = "html", seed: int = 11) -> Field:
    """Field trained on at most about ``sample`` pages, chosen by a hash of their html."""
    html_ = pages.select(F.col(column).alias("html")).where(F.col(column).isNotNull() & (F.length(column) > 0) & F.lower(F.col(column)).rlike("<(article|main)[\\s>]"))
    total = html_.count()
    if total > sample:
        html_ = html_.where(F.pmod(F.xxhash64("html", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    return train(sorted({r["html"] for r in html_.distinct().limit(4 * sample).collect()}))


def extracted(pages: DataFrame, field: Field, column: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text, instead of ``column``; a column named text is replaced."""
    keep = [c for c in pages.columns if c not in (column, "text")]
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [shared.value.extract(h or "") for h in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    source = pages.select(*keep, column)
    schema = pages.select(*keep).schema.add("text", "string")
    return source.mapInArrow(run, schema)
