"""HTML to Markdown as an Arrow UDF.

The per-row work is a small stdlib ``html.parser`` walk; Spark partitions
the rows, Arrow moves them in batches.  Rules (our own, goldens in tests):
headings ``#``..``######``; paragraphs / block containers separated by a
blank line; ``br`` a line break; links ``[text](href)``; images
``![alt](src)``; ``b/strong`` ``**``; ``i/em`` ``*``; inline ``code`` in
backticks; ``pre`` as a fenced block whose language is the first class
token's last ``-`` segment (X2); lists ``* `` / ``1. ``; ``blockquote`` lines
prefixed ``> ``; ``script``, ``style``, ``head`` and comments dropped;
entities decoded.  Then X3 (blank-line runs collapse, strip) and X4.

FIXED RULES, set by the corpus format: the language of a code block (X2), blank
lines (X3), characters that cannot be encoded (X4); `qforge.functions.text` has
them as column functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DROP = {"script", "style", "head", "noscript", "template"}
_BLOCK = {"p", "div", "article", "section", "nav", "footer", "header", "main", "aside",
          "table", "tr", "form", "figure", "body", "html", "ul", "ol", "dl"}
_HEAD = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
_VOID = {"br", "img", "hr", "meta", "link", "input"}
_BLANKS = re.compile(r"\n\s*\n")
_SPACES = re.compile(r"[ \t\r\n\f\v]+")
_QUOTE_ONLY = re.compile(r"(?:> ?)+ *")


def code_language(class_attr: str | None) -> str | None:
    """``lang-py s-code`` -> ``py``."""
    if not class_attr:
        return None
    first = class_attr.split()[0] if class_attr.split() else None
    return first.split("-")[-1] if first else None


class _Md(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.drop = 0
        self.pre = 0
        self.stack: list[tuple[str, dict]] = []
        self.lists: list[list] = []   # [kind, counter]
        self.quote = 0

    # -- helpers
    def _emit(self, s):
        if self.drop:
            return
        self.out.append(s)

    def _block(self):
        self._emit("\n\n" + "> " * self.quote)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _DROP:
            self.drop += 1
            return
        if tag not in _VOID:
            self.stack.append((tag, a))
        if tag in _HEAD:
            self._block()
            self._emit("#" * _HEAD[tag] + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self._block()
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            indent = "  " * max(len(self.lists) - 1, 0)
            bullet = f"{kind[1]}. " if kind[0] == "ol" else "* "
            self._emit("\n" + "> " * self.quote + indent + bullet)
        elif tag == "blockquote":
            self.quote += 1
            self._block()
        elif tag in _BLOCK:
            self._block()
        elif tag == "br":
            self._emit("  \n" + "> " * self.quote)
        elif tag == "hr":
            self._block()
            self._emit("---")
            self._block()
        elif tag in ("b", "strong"):
            self._emit("**")
        elif tag in ("i", "em"):
            self._emit("*")
        elif tag == "a":
            self._emit("[")
        elif tag == "img":
            self._emit(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "pre":
            code_cls = a.get("class")
            self.pre += 1
            self._block()
            self._emit("```" + (code_language(code_cls) or "") + "\n")
        elif tag == "code":
            if self.pre:
                lang = code_language(a.get("class"))
                if lang and self.out and self.out[-1] == "```\n":
                    self.out[-1] = f"```{lang}\n"
            else:
                self._emit("`")

    def handle_endtag(self, tag):
        if tag in _DROP:
            self.drop = max(0, self.drop - 1)
            return
        attrs = {}
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                attrs = self.stack[i][1]
                del self.stack[i:]
                break
        if tag in _HEAD or tag in _BLOCK:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self._block()
        elif tag == "blockquote":
            self.quote = max(0, self.quote - 1)
            self._block()
        elif tag in ("b", "strong"):
            self._emit("**")
        elif tag in ("i", "em"):
            self._emit("*")
        elif tag == "a":
            href = attrs.get("href")
            self._emit(f"]({href})" if href else "]")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            ends_nl = bool(self.out) and self.out[-1].endswith("\n")
            self._emit("```" if ends_nl else "\n```")
            self._block()
        elif tag == "code" and not self.pre:
            self._emit("`")

    def handle_data(self, data):
        if self.drop:
            return
        if self.pre:
            self._emit(data)
        else:
            self._emit(_SPACES.sub(" ", data))


def markdown_of(html: str | None) -> str | None:
    """One document; X3 and X4 applied to the result."""
    if html is None:
        return None
    p = _Md()
    p.feed(html)
    p.close()
    text = "".join(p.out)
    lines = []
    for line in text.split("\n"):
        if _QUOTE_ONLY.fullmatch(line):
            line = ""          # a quote marker with nothing after it
        elif not line.endswith("  "):
            line = line.rstrip(" ")
        lines.append(line)
    text = "\n".join(lines)
    text = _BLANKS.sub("\n\n", text).strip()
    return text.encode("utf-8", "replace").decode()


SLICE_ROWS = 64            # pages held as Python text at a time


@F.arrow_udf(T.StringType())
def _html_to_markdown_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    # a batch may hold ten thousand pages: only a slice of it is decoded, and handed on, at once
    for html in batches:
        for at in range(0, len(html), SLICE_ROWS):
            yield pa.array([markdown_of(x) for x in html.slice(at, SLICE_ROWS).to_pylist()], pa.string())


def html_to_markdown(col):
    """Column -> Column: Markdown of an HTML string column."""
    c = F.col(col) if isinstance(col, str) else col
    return _html_to_markdown_udf(c)
