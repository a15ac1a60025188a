"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import put, slices, with_fields

#: HTML's elements by how they take part in text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = "script style noscript template iframe textarea title".split()
FOREIGN = {"svg", "math"}
BREAKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
REGIONS = set("article main nav aside header footer form section figure table body".split())
#: An opening tag ends an open element of these names.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: ... and these end an open paragraph.
ENDS_P = BREAKS - {"body", "html", "button", "label", "option", "optgroup", "select", "textarea", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
#: An implied end never goes out of these.
SCOPES = {"ul", "ol", "table", "div", "article", "section", "aside", "nav", "main", "form", "button", "body", "td", "blockquote", "dl", "figure"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?:svg|math)(?=[\s/>])(?:\s++|/(?!>)|[^\s\"'>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+)*+/>"
    r"|<(?P<raw>" + "|".join(UNSEEN) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # tags from the root
    names: frozenset[str]  # parts of class, id and role of all ancestors
    linked: int  # characters inside links


def leaf_blocks(page: str) -> list[Block]:
    """The page's runs of text between block boundaries, references decoded, white space as single blanks; none empty.

    A head has no text of its own: other text than that of unseen elements ends it, as in browsers, with or without its end tag.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    state = {"linked": 0, "foreign": False}

    def foreign() -> int:
        """Where an open drawing or formula begins; -1 outside."""
        return next((k for k, (t, _) in enumerate(stack) if t in FOREIGN), -1) if state["foreign"] else -1

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                names = stack[-1][1] if stack else frozenset()
                out.append(Block(text, tuple(t for t, _ in stack if t in BREAKS), names, state["linked"]))
            parts.clear()
        state["linked"] = 0

    def add(raw: str) -> None:
        if raw and foreign() < 0:
            parts.append(html.unescape(raw) if "&" in raw else raw)
            if any(t == "a" for t, _ in stack[-4:]):
                state["linked"] += len(raw)

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if name == "head":
            continue
        if name in FOREIGN:
            state["foreign"] = True
        elif name in BREAKS and not m["end"] and not m["end2"] and (k := foreign()) >= 0 and all(t != "foreignobject" for t, _ in stack[k:]):
            del stack[k:]  # a text element ends an unclosed drawing, as in browsers
        if name in BREAKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if name not in BREAKS and stack[k][0] in BREAKS:
                    break
        elif name not in VOID:
            ends = ENDS.get(name, frozenset()) | ({"p"} if name in ENDS_P else set())
            if ends:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPES:
                        break
            names = stack[-1][1] if stack else frozenset()
            rest = m["rest"]
            if rest and "=" in rest:
                own = frozenset(p for v in _NAMED.findall(rest) for p in _PART.findall(v.lower()))
                names = names | own if own else names
            stack.append((name, names))
    add(page[at:])
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Of each block: ancestor tags, the nearest region, parts of names, and the shape of the text."""
    out = []
    for k, b in enumerate(blocks):
        n = len(b.text)
        words = b.text.count(" ") + 1
        region = next((t for t in reversed(b.path) if t in REGIONS), "none")
        found = {f"a={t}" for t in b.path} | {f"n={p}" for p in b.names}
        found |= {"always", f"t={b.path[-1] if b.path else 'none'}", f"r={region}", f"size={min(9, n.bit_length())}", f"words={min(7, words.bit_length())}", f"link={min(4, 4 * b.linked // n)}"}
        found.add(f"stop={b.text[-1] in '.!?…。'}")
        if "©" in b.text:
            found.add("copyright")
        if k == 0:
            found.add("first")
        if k == len(blocks) - 1:
            found.add("last")
        out.append(sorted(found))
    return out


@dataclass
class Field:
    """Weights of label 1 (main text) against 0 by feature, of steps from label to label, and of the first label."""

    weights: dict[str, float]
    step: list[list[float]]
    start: list[float]

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels in all (Viterbi)."""
        if not rows:
            return []
        get = self.weights.get
        (s00, s01), (s10, s11) = self.step
        zero, one, back = 0.0, 0.0, []
        for k, row in enumerate(rows):
            own = sum([get(f, 0.0) for f in row])
            if k == 0:
                zero, one = self.start[0], self.start[1] + own
                continue
            a, b = zero + s00 > one + s10, zero + s01 > one + s11
            back.append((0 if a else 1, 0 if b else 1))
            zero, one = (zero + s00 if a else one + s10), (zero + s01 if b else one + s11) + own
        label = int(one >= zero)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 200, rate: float = 0.15, decay: float = 0.001) -> Field:
    """Maximum conditional likelihood by forward-backward sums over all pages at once (padded), with decay."""
    names = sorted({f for rows, _ in pages for row in rows for f in row})
    place = {f: i for i, f in enumerate(names)}
    n, longest = len(pages), max(len(r) for r, _ in pages)
    page, turn, feature = (np.array(x) for x in zip(*[(p, t, place[f]) for p, (rows, _) in enumerate(pages) for t, row in enumerate(rows) for f in row]))
    gold = np.zeros((n, longest), np.int64)
    real = np.zeros((n, longest), bool)
    for p, (_, labels) in enumerate(pages):
        gold[p, : len(labels)], real[p, : len(labels)] = labels, True
    both = real[:, 1:]
    theta = np.zeros(len(names) + 6)
    seen = np.zeros(len(theta))
    np.add.at(seen, feature, gold[page, turn])
    for i in (0, 1):
        seen[-2 + i] = (gold[:, 0] == i).sum()
        for j in (0, 1):
            seen[len(names) + 2 * i + j] = ((gold[:, :-1] == i) & (gold[:, 1:] == j) & both).sum()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        emit = np.zeros((n, longest, 2))
        np.add.at(emit[:, :, 1], (page, turn), theta[feature])
        step, start = theta[len(names) : -2].reshape(2, 2), theta[-2:]
        ahead = np.zeros((longest, n, 2))
        behind = np.zeros((longest, n, 2))
        ahead[0] = start + emit[:, 0]
        for t in range(1, longest):
            ahead[t] = np.where(real[:, t, None], np.logaddexp(ahead[t - 1][:, :1] + step[0], ahead[t - 1][:, 1:] + step[1]) + emit[:, t], ahead[t - 1])
        for t in range(longest - 2, -1, -1):
            then = behind[t + 1] + emit[:, t + 1]
            behind[t] = np.where(real[:, t + 1, None], np.logaddexp(step[:, 0] + then[:, :1], step[:, 1] + then[:, 1:]), behind[t + 1])
        whole = np.logaddexp(ahead[-1][:, 0], ahead[-1][:, 1])
        chance = np.exp(ahead + behind - whole[:, None]).transpose(1, 0, 2)
        expected = np.zeros(len(theta))
        np.add.at(expected, feature, chance[page, turn, 1])
        expected[-2:] = chance[:, 0].sum(axis=0)
        then = (behind[1:] + emit[:, 1:].transpose(1, 0, 2))[:, :, None, :]
        pair = np.exp(ahead[:-1][:, :, :, None] + step + then - whole[None, :, None, None])
        expected[len(names) : -2] = (pair * both.T[:, :, None, None]).sum(axis=(0, 1)).reshape(-1)
        grad = (expected - seen) / n + decay * theta
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        theta -= rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Field({f: float(theta[i]) for f, i in place.items()}, theta[len(names) : -2].reshape(2, 2).tolist(), theta[-2:].tolist())


def labelled_pages(count: int = 400, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Pages made by rule whose blocks' labels are known: 1 for main text, 0 for all else."""
    r = random.Random(seed)
    letters = "aeinorstlu"

    def words(n: int) -> str:
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 11))) for _ in range(n))

    def sentence(most: int = 14) -> str:
        return words(r.randint(1, most)).capitalize() + r.choice(".....!?")

    def prose() -> str:
        text = " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))))
        if r.random() < 0.08:
            text = text.replace(" ", r.choice((" * ", "# ", "$ ", " 12 ", "!! ", ", "))) + r.choice(("", "&&", "***"))
        return f"<b>{text}</b>" if r.random() < 0.1 else text.replace(" ", ' <a href="#">', 1).replace(".", "</a>.", 1) if r.random() < 0.15 and " " in text and "." in text else text

    def attrs(*choices: str, always: bool = False) -> str:
        name = r.choice(choices)
        return f' {r.choice(("class", "id"))}="{name}"' if name and (always or r.random() < 0.85) else ""

    def told(tag: str, *choices: str) -> tuple[str, str]:
        """A part that isn't the text says so by its tag, or else by its name."""
        return tag, attrs(*choices, always=True) if tag in ("div", "section") or r.random() < 0.5 else ""

    def any_name() -> str:
        """Of a container that says nothing about what is in it: none, or a word of layouts or of no meaning."""
        name = r.choice(("", "", "app", "wrapper", "container", "col", "row", "page", "site", "inner", "outer", "layout", "grid", "box", words(1), words(1), f"{words(1)}-{words(1)}", f"col-md-{r.randint(1, 12)}"))
        return f' {r.choice(("class", "id"))}="{name}"' if name else ""

    def links(n: int, tag: str = "li") -> list[tuple[str, int]]:
        return [(f'<{tag}><a href="/x">{words(r.randint(1, 4))}</a></{tag}>', 0) for _ in range(n)]

    def box(tag: str, name: str, inside: list[tuple[str, int]]) -> list[tuple[str, int]]:
        return [(f"<{tag}{name}>", -1), *inside, (f"</{tag}>", -1)]

    def nav() -> list:
        return box(*told(r.choice(("nav", "nav", "div")), "menu", "nav", "navbar", "topnav", "breadcrumbs", "navigation"), box("ul", "", links(r.randint(2, 9))))

    def advert() -> list:
        return box(r.choice(("div", "div", "aside", "section")), attrs("ad", "ads", "advert", "banner", "sponsored", "promo", "advertisement", always=True), [(sentence(9) if r.random() < 0.6 else f"<p>{sentence(9)}</p>", 0)])

    def notice() -> list:
        return box("div", attrs("cookie-notice", "cookies", "consent", "notice", "alert", "gdpr", always=True), [(f"<p>{sentence()} {sentence()}</p>", 0), (f"<button>{words(2)}</button>", 0)])

    def form() -> list:
        return box("form", attrs("newsletter", "search", "signup", "subscribe", "login"), [(f"<label>{words(2)}</label>", 0), (f"<p>{sentence()}</p>", 0), (f"<button>{words(1)}</button>", 0)])

    def comments() -> list:
        each = []
        for _ in range(r.randint(1, 5)):
            each += box(r.choice(("div", "li", "article")), attrs("comment", "comment-body", "reply"), [(f"<p>{sentence()} {sentence(25)}</p>", 0)])
        return box(r.choice(("section", "div", "ol")), f' {r.choice(("class", "id"))}="{r.choice(("comments", "comment-list", "discussion", "replies", "responses"))}"', [(f"<h2>{words(1)}</h2>", 0), *each])

    def aside() -> list:
        return box(*told(r.choice(("aside", "aside", "div")), "sidebar", "side", "widget", "related", "share", "social"), [(f"<h3>{words(2)}</h3>", 0), *(box("ul", "", links(r.randint(1, 6))) if r.random() < 0.6 else [(f"<p>{sentence()} {sentence()}</p>", 0)])])

    def header() -> list:
        return box(*told("header", "header", "masthead", "top"), [(r.choice(("<div>%s</div>", "<h1>%s</h1>", "<p>%s</p>")) % words(r.randint(1, 4)), 0), *(nav() if r.random() < 0.4 else [])])

    def footer() -> list:
        return box(*told(r.choice(("footer", "footer", "div")), "footer", "footer", "site-footer", "bottom"), [(f"{r.choice(('&copy; ', '&copy; ', ''))}{words(3)}. {sentence(8)}", 0), *(links(r.randint(0, 4), "p"))])

    def article(rich: bool) -> list:
        inside: list = [(f"<h1>{words(r.randint(1, 12))}{r.choice(('', '.'))}</h1>", 1)] if r.random() < 0.9 else []
        for _ in range(r.choice((1, 2, 3, 5, 8, 12))):
            kind = r.random()
            if kind < 0.72 or not rich:
                inside.append((f"<p>{prose()}{r.choice(('</p>', '</p>', '</p>', '<br>'))}", 1))
            elif kind < 0.8:
                inside.append((f"<h{r.choice('23')}>{words(r.randint(1, 6))}</h{2}>", 1))
            elif kind < 0.86:
                inside += box(r.choice(("ul", "ol")), "", [(f"<li>{prose()}</li>", 1) for _ in range(r.randint(1, 5))])
            elif kind < 0.9:
                inside.append((f"<blockquote>{prose()}</blockquote>", 1))
            elif kind < 0.93:
                inside.append((f"<pre>{words(6)}</pre>", 1))
            elif kind < 0.96:
                inside += box("table", "", box("tr", "", [(f"<td>{words(2)}</td>", 1) for _ in range(3)]))
            else:
                inside += r.choice((advert, aside, form))()
        if rich and r.random() < 0.3:
            inside += r.choice((aside, comments, form))()
        if r.random() < 0.5:  # the container has any name or none, or there is none
            for _ in range(r.choice((0, 1, 1, 1, 2, 3))):
                inside = box(*(("section", any_name()) if r.random() < 0.15 else ("div", any_name() if r.random() < 0.93 else ' role="main"')), inside)
            return inside
        return box(*r.choice((("article", ""), ("article", ""), ("article", attrs("post", "story")), ("main", ""), ("div", ' class="content"'), ("div", ' class="article-body"'), ("div", ' id="main-content"'), ("div", ' class="post entry"'), ("section", ' class="story"'))), inside)

    pages = []
    for _ in range(count):
        before, after = [nav, header, advert, notice, form], [aside, comments, advert, form, nav]
        parts: list = []
        for make in r.sample(before, r.randint(0, 4)):
            parts += make()
        main = article(r.random() < 0.6)
        for make in r.sample(after, r.randint(0, 3)):
            main = make() + main if make is aside and r.random() < 0.3 else main + make()
        parts += box("main", "", main) if r.random() < 0.15 else main
        around = r.random()
        if around < 0.15:
            parts = box("div", any_name(), parts)
        if r.random() < 0.85:
            parts += footer()
        if 0.15 <= around < 0.3:
            parts = box("div", any_name(), parts)
        page = "".join(s for s, _ in parts)
        pages.append((f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style></head><body>{page}</body></html>", [y for _, y in parts if y >= 0]))
    for _ in range(count // 2):  # pages of few blocks, of which all or most are the text
        inside = [(f"<{t}>{prose()}{r.choice((f'</{t}>', f'</{t}>', '<br>' if t == 'p' else f'</{t}>'))}", 1) for t in r.choices(("p", "p", "p", "h1", "blockquote", "div"), k=r.choice((1, 1, 1, 2, 3, 8)))]
        if r.random() < 0.15:
            inside = [(f"{sentence()}<br>{sentence()}", 1)]
        parts = box(*r.choice((("article", ""), ("article", ""), ("main", ""), ("div", any_name()), ("div", any_name()), ("section", ""), ("div", ' class="content"'))), inside) if r.random() < 0.75 else inside
        parts = [*(nav() if r.random() < 0.4 else []), *parts, *(aside() if r.random() < 0.2 else []), *(footer() if r.random() < 0.7 else [])]
        page = "".join(s for s, _ in parts)
        pages.append((page if r.random() < 0.5 else f"<html><body>{page}</body></html>", [y for _, y in parts if y >= 0]))
    return pages


def train(pages: list[tuple[str, list[int]]] | None = None) -> Field:
    """Fit on labelled pages: (html, a label for each leaf block); without any, on pages made by rule, once for each process."""
    if not pages:
        return _by_rule()
    rows = [(leaf_blocks(page), labels) for page, labels in pages]
    return fit([(features(b), y) for b, y in rows if len(b) == len(y) and b])


@functools.cache
def _by_rule() -> Field:
    return train(labelled_pages())


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n".join([b.text for b, y in zip(blocks, field.decode(features(blocks))) if y])


def extract(pages: DataFrame, html_col: str = "html", field: Field | None = None, name: str = "text") -> DataFrame:
    """``pages`` with the main text of each: the blocks of label 1, in page order, joined by line feeds.

    Null counts as empty and gives an empty text; text outside all elements is a block too; repeated
    rows get equal results; an empty table gives an empty one; a column named as the output gives way.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or train())
    pages = pages.drop(name) if name != html_col else pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, html_col):
                texts = [main_text(p or "", shared.value) for p in batch.column(batch.schema.get_field_index(html_col)).to_pylist()]
                yield put(batch, **{name: pa.array(texts, pa.string())})

    return pages.mapInArrow(run, with_fields(pages.schema, (name, T.StringType())))
