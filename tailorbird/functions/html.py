"""Elements of HTML pages: all selectors of a page answered in one Arrow pass, by a tokenizer with a stack of open elements.

Markup may be nested, unclosed, unquoted or broken: an end tag closes what still stands open inside its element, one
without an element is ignored, elements that can't hold each other (paragraphs, list items, cells, options) end each
other, and what is open at the end of the page ends there. Comments, scripts and styles hold no text and no elements.

A selector is a chain of steps parted by spaces, each a tag, .class, #id, [name], [name=value], [name^=value], [name*=value] or
[name$=value], or several of these together; commas part alternatives. Tags and attribute names are read in any case.

Null pages give null; where nothing matches, a text is empty and a list has no elements.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?:(?P<held>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)|(?P<loose>[^>]*+))>", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_STEP = re.compile(r"""([a-zA-Z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:([\^*$]?=)\s*["']?([^"'\]]*)["']?\s*)?\]""")
_SPACE = re.compile(r"[ \t\n\r\f]+")

#: Elements without an end, those whose content isn't markup, and those that begin a line of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title".split())
HIDDEN = frozenset("script style template".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li "
    "main nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
#: Which open elements a new one ends, and beyond which it looks no further.
_IN_PARAGRAPH = BLOCKS - frozenset("body html li dd dt option tbody tfoot thead tr".split())
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "option": (frozenset(["option"]), frozenset(["select"])),
    **{tag: (frozenset(["p"]), frozenset(["td", "th", "table", "button", "li", "body"])) for tag in _IN_PARAGRAPH},
}


@dataclass
class _Element:
    tag: str
    held: str
    texts: list[list[str]] = field(default_factory=list)  # where text inside goes to

    def __post_init__(self):
        self._attributes = None

    @property
    def attributes(self) -> dict[str, str]:
        if self._attributes is None:
            found = _ATTRIBUTE.findall(self.held) if self.held else ()
            self._attributes = {}
            for name, double, single, bare in found:
                self._attributes.setdefault(name.lower(), unescape(double or single or bare))
        return self._attributes


@dataclass(frozen=True)
class _Step:
    """What one element must be."""

    tag: str | None
    tests: tuple[tuple[str, str, str], ...]

    def fits(self, element: _Element) -> bool:
        if self.tag and self.tag != element.tag:
            return False
        if not self.tests:
            return True
        own = element.attributes
        for name, how, value in self.tests:
            there = own.get(name)
            if there is None or not (
                how == "" or (how == "~=" and value in there.split()) or (how == "=" and there == value)
                or (how == "^=" and value and there.startswith(value)) or (how == "*=" and value and value in there)
                or (how == "$=" and value and there.endswith(value))
            ):
                return False
        return True


@lru_cache(maxsize=1000)
def selector_steps(selector: str) -> tuple[tuple[_Step, ...], ...]:
    """The alternatives of a selector, each from its innermost step outwards."""
    out = []
    for alternative in selector.split(","):
        steps = []
        for word in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", alternative):
            if _STEP.sub("", word):
                raise ValueError(f"no selector: {selector!r}")
            tag, tests = None, []
            for name, cls, own_id, attribute, how, value in _STEP.findall(word):
                if name and name != "*":
                    tag = name.lower()
                elif cls or own_id:
                    tests.append(("class", "~=", cls) if cls else ("id", "=", own_id))
                elif attribute:
                    tests.append((attribute.lower(), how, value))
            steps.append(_Step(tag, tuple(tests)))
        if not steps:
            raise ValueError(f"no selector: {selector!r}")
        out.append(tuple(reversed(steps)))
    return tuple(out)


def _matches(stack: list[_Element], element: _Element, alternatives: tuple[tuple[_Step, ...], ...]) -> bool:
    for target, *outer in alternatives:
        if target.fits(element):
            at = len(stack)
            for step in outer:  # the nearest ancestor that fits is enough, as steps stand for any distance
                at = next((i for i in range(at - 1, -1, -1) if step.fits(stack[i])), -1)
                if at < 0:
                    break
            else:
                return True
    return False


def _joined(parts: list[str], rendered: bool) -> str:
    if not rendered:
        return "\n".join(p for p in parts if p)
    lines = ("".join(parts)).split("\n")
    return "\n".join(x for line in lines if (x := re.sub(" *\t *", "\t", re.sub(" +", " ", line)).strip()))


def take(page: str, wanted: dict[str, tuple[str, str]], rendered: bool = False) -> dict[str, str | list[str]]:
    """For each name (selector, what): `text` of the first element, `texts` of all, or `@name`, that attribute of all that have it.

    A text has a line for each piece of text; `rendered` has lines as a browser shows them instead: blocks, rows and <br> break
    lines, white space runs together, and cells are parted by tabs. `body` is the whole page where it has no such element.
    """
    asked = {name: (selector_steps(selector), what) for name, (selector, what) in wanted.items()}
    found: dict[str, list] = {name: [] for name in wanted}
    whole: list[str] = []
    stack = [_Element("", "", [whole])]
    sinks: list[list[str]] = [whole]
    standing: Counter[str] = Counter()  # open elements by tag

    def put(text: str) -> None:
        if rendered:
            text = _SPACE.sub(" ", unescape(text))
        else:
            text = unescape(text).strip()
        if text:
            for sink in sinks:
                sink.append(text)

    def put_edge(sign: str) -> None:
        for sink in sinks:
            sink.append(sign)

    def edge(tag: str) -> None:
        if rendered and (tag in BLOCKS or tag == "br"):
            put_edge("\n")

    def close(count: int) -> None:
        for element in reversed(stack[count:]):
            standing[element.tag] -= 1
            if rendered and element.tag in ("td", "th"):
                put_edge("\t")
            edge(element.tag)
            if element.texts:  # the innermost are the last
                del sinks[len(sinks) - len(element.texts) :]
        del stack[count:]

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        tag = _TAG.search(page, at) if at <= last else None
        if tag is None:
            put(page[at:].partition("<!--")[0])
            break
        if tag.start() > at:
            put(page[at : tag.start()])
        at, name = tag.end(), tag["tag"]
        if not name:
            continue
        name = name.lower()
        if tag["end"]:
            if standing[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name))
            continue
        ended, beyond = ENDS.get(name, ((), ()))
        if any(standing[t] for t in ended):
            outermost = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in beyond:
                    break
                if stack[i].tag in ended:
                    outermost = i
            if outermost:
                close(outermost)
        held = (tag["held"] if tag["held"] is not None else tag["loose"]) or ""
        element = _Element(name, held.rstrip("/"))
        hits = []
        for key, (alternatives, what) in asked.items():
            if (what != "text" or not found[key]) and _matches(stack, element, alternatives):
                if what[0] == "@":
                    if value := element.attributes.get(what[1:].lower(), "").strip():
                        found[key].append(value)
                else:
                    text: list[str] = []
                    found[key].append(text)
                    hits.append(text)
        if name in VOID:
            edge(name)
            continue
        edge(name)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            inside, at = (page[at : end.start()], end.end()) if end else (page[at:], n)
            if name not in HIDDEN:
                sinks += hits
                put(inside)
                del sinks[len(sinks) - len(hits) :]
            continue
        element.texts = hits
        sinks += hits
        stack.append(element)
        standing[name] += 1
    out = {}
    for key, (_, what) in asked.items():
        if what == "text":
            first = found[key][0] if found[key] else whole if wanted[key][0] == "body" else []
            out[key] = _joined(first, rendered)
        else:
            out[key] = found[key] if what[0] == "@" else [_joined(t, rendered) for t in found[key]]
    return out


def elements(html: Column, wanted: dict[str, tuple[str, str]], rendered: bool = False) -> Column:
    """A struct of what `take` finds on each page."""
    kinds = StructType([StructField(name, StringType() if what == "text" else ArrayType(StringType())) for name, (_, what) in wanted.items()])
    for selector, _ in wanted.values():
        selector_steps(selector)  # a wrong one is told here and not in a task
    arrow = pa.struct([(name, pa.string() if what == "text" else pa.list_(pa.string())) for name, (_, what) in wanted.items()])

    @F.arrow_udf(kinds)
    def taken(pages: pa.Array) -> pa.Array:
        return pa.array([None if (p := page.as_py()) is None else take(p, wanted, rendered) for page in pages], arrow)

    return taken(html)
