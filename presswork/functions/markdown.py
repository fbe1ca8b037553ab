"""CommonMark to HTML, as an Arrow-batched function of a column.

One pass over the lines with a stack of open containers (quotes, lists, items) makes a tree of blocks; then each leaf's text is read
once with a stack of delimiter runs and brackets. Raw HTML is shown as text unless asked for, as pages hold texts that others wrote.
Containers nest ``DEPTH`` deep; what would open one more is text of the innermost.

A null text is null, an empty one is empty; tabs in indents count to the next multiple of four; all three kinds of line ends are one.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, functions as F

DEPTH = 20
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
HEADING = re.compile(r"(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
MARKER = re.compile(r"([-+*])(?=[ \t]|$)|(\d{1,9})([.)])(?=[ \t]|$)")
DEFINITION = re.compile(r"""\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*(?:\n[ \t]*|[ \t])("[^"]*"|'[^']*'|\([^()]*\)))?[ \t]*(?:\n|$)""")
TARGET = re.compile(r"""\(\s*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()<\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)""", re.S)
LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>|<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+)>")
TAG = re.compile(r"<(?:/[A-Za-z][\w-]*\s*|[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|!--.*?--)>", re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
RUN = re.compile(r"`+|\*+|_+")
PLAIN = re.compile(r"[^\\`*_\[\]<&!\n]+")


# --- blocks -------------------------------------------------------------------------------------------------------------


@dataclass
class Block:
    kind: str
    start: int
    last: int
    lines: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    level: int = 0  # of a heading; the offset of an item; the first number of a list
    mark: str = ""  # of a list or a fence
    info: str = ""

    def end(self) -> int:
        return max([self.last, *(b.end() for b in self.blocks[-1:])])


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _leading(line: str) -> str:
    body = line.lstrip(" \t")
    return line[: len(line) - len(body)].expandtabs(4) + body


class Reader:
    """The open blocks, outermost first; at most the last is a leaf."""

    def __init__(self) -> None:
        self.open = [Block("page", 0, 0)]
        self.links: dict[str, tuple[str, str]] = {}
        self.at = 0

    def page(self, text: str) -> Block:
        for self.at, line in enumerate(re.split(r"\r\n?|\n", text)):
            self.line(_leading(line))
        self.close(1)
        return self.open[0]

    def close(self, to: int) -> None:
        while len(self.open) > to:
            done = self.open.pop()
            if done.kind == "p":
                text = "\n".join(done.lines)
                while found := DEFINITION.match(text):
                    where = found[2][1:-1] if found[2].startswith("<") else found[2]
                    self.links.setdefault(_label(found[1]), (_plain(where), _plain((found[3] or "")[1:-1])))
                    text = text[found.end() :]
                done.lines = [text]
                if not text.strip():
                    self.open[-1].blocks = [b for b in self.open[-1].blocks if b is not done]
            elif done.kind == "indented":
                done.lines = "\n".join(done.lines).rstrip("\n ").split("\n")

    def put(self, at: int, kind: str, **more) -> Block:
        """A new block in the container at place ``at``, after all else there is closed."""
        self.close(at + 1)
        if self.open[-1].kind == "list" and kind != "item":
            self.close(at)
        new = Block(kind, self.at, self.at, **more)
        self.open[-1].blocks.append(new)
        self.open.append(new)
        return new

    def line(self, line: str) -> None:
        matched = 1
        for block in self.open[1:]:
            indent, blank = _indent(line), not line.strip()
            if block.kind == "quote":
                if indent > 3 or line[indent : indent + 1] != ">":
                    break
                line = _leading(line[indent + 1 :])
                line = line[1:] if line.startswith(" ") else line
            elif block.kind == "item":
                if blank and not block.blocks and block.start < self.at:
                    break
                if not blank and indent < block.level:
                    break
                line = "" if blank else line[block.level :]
            elif block.kind == "fence":
                found = FENCE.match(line[indent:])
                mark = found and (found[1] or found[3])
                if indent <= 3 and mark and mark[0] == block.mark[0] and len(mark) >= len(block.mark) and not (found[2] or found[4] or "").strip():
                    block.last = self.at
                    self.close(matched)
                    return
                block.lines.append(line[min(indent, block.level) :])
                block.last = self.at
                return
            elif block.kind == "indented":
                if not blank and indent < 4:
                    break
                block.lines.append(line[4:])
                block.last = block.last if blank else self.at
                return
            elif block.kind == "p" and blank:
                break
            matched += 1
        tip = self.open[-1]
        going = tip.kind == "p" and matched == len(self.open)  # the paragraph may go on
        at = matched - 2 if going else matched - 1
        began = False
        while line.strip():
            indent, body = _indent(line), line.lstrip(" ")
            if indent > 3:
                if tip.kind == "p" and not began:
                    break
                self.put(at, "indented").lines.append(line[4:])
                return
            deep = len(self.open) > DEPTH and at + 1 >= DEPTH
            if body[0] == ">" and not deep:
                self.put(at, "quote")
                line = _leading(body[1:])
                line = line[1:] if line.startswith(" ") else line
            elif body[0] == "#" and (found := HEADING.match(body)):
                self.put(at, "heading", level=len(found[1])).lines = [(found[2] or "").strip()]
                self.close(len(self.open) - 1)
                return
            elif found := FENCE.match(body):
                self.put(at, "fence", level=indent, mark=found[1] or found[3], info=_plain((found[2] or found[4] or "").strip()))
                return
            elif going and not began and (found := UNDERLINE.match(body)) and DEFINITION.sub("", "\n".join(tip.lines)).strip():
                tip.kind, tip.level, tip.last = "heading", 1 if found[1][0] == "=" else 2, self.at
                self.close(len(self.open) - 1)
                return
            elif RULE.match(body):
                self.put(at, "rule")
                self.close(len(self.open) - 1)
                return
            elif (found := MARKER.match(body)) and not deep and not (going and not began and (not body[found.end() :].strip() or (found[2] or "1").lstrip("0") != "1")):
                mark, rest = found[1] or found[3], _leading(" " * found.end() + body[found.end() :])[found.end() :]
                gap = _indent(rest) if rest.strip() else 1
                gap = 1 if gap > 4 else gap
                holder = self.open[at]
                if not (holder.kind == "list" and holder.mark == mark):
                    self.put(at, "list", mark=mark, level=int(found[2] or 1))
                    at = len(self.open) - 1
                self.put(at, "item", level=indent + found.end() + gap)
                line = rest[gap:]
            else:
                break
            at, began, tip = len(self.open) - 1, True, self.open[-1]
        if not line.strip():
            if not began:
                self.close(at + 1)
        elif tip.kind == "p" and not began:  # as it goes on, or though its containers didn't match
            tip.lines.append(line.strip(" \t") if not line.endswith("  ") else line.strip(" \t") + "  ")
            for block in self.open:
                block.last = self.at
        else:
            self.put(at, "p").lines.append(line.strip(" \t") if not line.endswith("  ") else line.strip(" \t") + "  ")


# --- what is in a line --------------------------------------------------------------------------------------------------


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _plain(text: str) -> str:
    """Without escapes and with entities resolved."""
    return re.sub(rf"\\([{re.escape(PUNCTUATION)}])|({ENTITY.pattern})", lambda m: m[1] or html.unescape(m[2]), text)


def _address(url: str) -> str:
    return html.escape(quote(url, safe=PUNCTUATION.replace("[", "").replace("]", "").replace("\\", "").replace("`", "").replace('"', "") + "%"))


def _safe(text: str) -> str:
    return html.escape(text).replace("&#x27;", "'")


@dataclass
class Run:
    """Text, or what is left of a run of delimiters, with the tags before and after it."""

    text: str
    mark: str = ""
    opens: bool = False
    closes: bool = False
    length: int = 0
    before: str = ""
    after: str = ""

    def html(self) -> str:
        return self.before + self.text + self.after


def inline(text: str, links: dict[str, tuple[str, str]], raw_html: bool = False) -> str:
    runs: list[Run] = []
    brackets: list[tuple[int, int, bool]] = []  # run, place in the text, image
    dead: set[int] = set()
    lost: set[int] = set()
    at, text = 0, text.strip()
    while at < len(text):
        c = text[at]
        if found := PLAIN.match(text, at):
            plain = found[0]
            at = found.end()
            if text[at : at + 1] == "\n":
                kept = plain.rstrip(" ")
                runs.append(Run(_safe(kept) + ("<br />" if len(plain) - len(kept) > 1 else "")))
            else:
                runs.append(Run(_safe(plain)))
        elif c == "\n":
            runs.append(Run("\n"))
            at += 1
            while text[at : at + 1] == " ":
                at += 1
        elif c == "\\":
            after = text[at + 1 : at + 2]
            if after == "\n":
                runs.append(Run("<br />"))
                at += 1
            elif after and after in PUNCTUATION:
                runs.append(Run(_safe(after)))
                at += 2
            else:
                runs.append(Run("\\"))
                at += 1
        elif c == "`":
            n = RUN.match(text, at).end() - at
            end = -1 if n in lost else next((m.start() for m in re.compile(rf"(?<!`)`{{{n}}}(?!`)").finditer(text, at + n)), -1)
            if end < 0:
                lost.add(n)
                runs.append(Run("`" * n))
                at += n
            else:
                code = text[at + n : end].replace("\n", " ")
                code = code[1:-1] if code.strip(" ") and code[0] == code[-1] == " " else code
                runs.append(Run(f"<code>{_safe(code)}</code>"))
                at = end + n
        elif c == "<" and (found := AUTOLINK.match(text, at)):
            where = found[1] or f"mailto:{found[2]}"
            runs.append(Run(f'<a href="{_address(where)}">{_safe(found[1] or found[2])}</a>'))
            at = found.end()
        elif c == "<" and raw_html and (found := TAG.match(text, at)):
            runs.append(Run(found[0]))
            at = found.end()
        elif c == "&" and (found := ENTITY.match(text, at)):
            runs.append(Run(_safe(html.unescape(found[0]))))
            at = found.end()
        elif c in "*_":
            n = RUN.match(text, at).end() - at
            before, after = text[at - 1 : at] or " ", text[at + n : at + n + 1] or " "
            mark_before, mark_after = _marks(before), _marks(after)
            left = not after.isspace() and (not mark_after or before.isspace() or mark_before)
            right = not before.isspace() and (not mark_before or after.isspace() or mark_after)
            opens = left if c == "*" else left and (not right or mark_before)
            closes = right if c == "*" else right and (not left or mark_after)
            runs.append(Run(c * n, c, opens, closes, n))
            at += n
        elif c == "[" or text.startswith("![", at):
            brackets.append((len(runs), at, c == "!"))
            runs.append(Run("![" if c == "!" else "["))
            at += 2 if c == "!" else 1
        elif c == "]" and brackets:
            first, place, image = brackets.pop()
            found = None if first in dead else _target(text, at + 1, text[place + (2 if image else 1) : at], links)
            if found:
                where, title, at = found
                _emphasis(runs, first + 1)
                inner = "".join(r.html() for r in runs[first + 1 :])
                title = f' title="{_safe(title)}"' if title else ""
                alt = re.sub("<[^>]*>", "", re.sub(r'<img [^>]*alt="([^"]*)"[^>]*>', r"\1", inner))
                runs[first:] = [Run(f'<img src="{_address(where)}" alt="{alt}"{title} />' if image else f'<a href="{_address(where)}"{title}>{inner}</a>')]
                if not image:  # no links in links
                    dead.update(k for k, _, is_image in brackets if not is_image)
            else:
                runs.append(Run("]"))
                at += 1
        else:
            runs.append(Run(_safe(c)))
            at += 1
    _emphasis(runs, 0)
    return "".join(r.html() for r in runs)


def _marks(c: str) -> bool:
    return c in PUNCTUATION or (ord(c) > 127 and not c.isalnum() and not c.isspace())


def _target(text: str, at: int, inner: str, links: dict[str, tuple[str, str]]) -> tuple[str, str, int] | None:
    """Address and title of a link whose text ends before ``at``, and where it ends."""
    if found := TARGET.match(text, at):
        return _plain(found[1] if found[1] is not None else found[2] or ""), _plain((found[3] or "")[1:-1]), found.end()
    found = LABEL.match(text, at)
    name = _label(found[1]) if found and found[1].strip() else _label(inner)
    return (*links[name], found.end() if found else at) if name in links else None


def _emphasis(runs: list[Run], start: int) -> None:
    """Pair the delimiter runs from ``start`` on; each closer takes the nearest opener that fits."""
    stack: list[int] = []
    bottom: dict[tuple, int] = {}
    for k in range(start, len(runs)):
        run = runs[k]
        if not run.mark:
            continue
        while run.closes and run.text:
            kind = (run.mark, run.length % 3, run.opens)
            low = bottom.get(kind, 0)
            for place in range(len(stack) - 1, low - 1, -1):
                opener = runs[stack[place]]
                odd = (opener.closes or run.opens) and (opener.length + run.length) % 3 == 0 and (opener.length % 3 or run.length % 3)
                if opener.mark == run.mark and not odd:
                    break
            else:
                bottom[kind] = len(stack)
                break
            n = 2 if len(opener.text) > 1 and len(run.text) > 1 else 1
            tag = "strong" if n == 2 else "em"
            opener.text, run.text = opener.text[n:], run.text[n:]
            opener.after, run.before = f"<{tag}>" + opener.after, run.before + f"</{tag}>"
            del stack[place + (1 if opener.text else 0) :]
            bottom = {key: min(b, len(stack)) for key, b in bottom.items()}
        if run.opens and run.text:
            stack.append(k)
    for run in runs[start:]:
        run.mark = ""


# --- HTML ---------------------------------------------------------------------------------------------------------------


def _write(block: Block, links: dict[str, tuple[str, str]], out: list[str], tight: bool, raw_html: bool) -> None:
    def fresh() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    text = "\n".join(block.lines)
    if block.kind == "p" and tight:
        if out and not out[-1].endswith(("<li>", "\n")):
            out.append("\n")
        out.append(inline(text, links, raw_html))
        return
    if block.kind == "item":
        out.append("<li>")
        for b in block.blocks:
            _write(b, links, out, tight, raw_html)
        out.append("</li>\n")
        return
    if block.kind != "page":
        fresh()
    if block.kind == "p":
        out.append(f"<p>{inline(text, links, raw_html)}</p>\n")
    elif block.kind == "heading":
        out.append(f"<h{block.level}>{inline(text, links, raw_html)}</h{block.level}>\n")
    elif block.kind == "rule":
        out.append("<hr />\n")
    elif block.kind in ("fence", "indented"):
        language = f' class="language-{_safe(block.info.split()[0])}"' if block.info.split() else ""
        out.append(f"<pre><code{language}>{_safe(text)}{chr(10) if block.lines else ''}</code></pre>\n")
    elif block.kind == "quote":
        out.append("<blockquote>\n")
        for b in block.blocks:
            _write(b, links, out, False, raw_html)
        fresh()
        out.append("</blockquote>\n")
    elif block.kind == "list":
        siblings = [block.blocks, *(item.blocks for item in block.blocks)]
        loose = any(a.end() + 1 < b.start for group in siblings for a, b in zip(group, group[1:]))
        ordered = block.mark in ".)"
        out.append("<ul>\n" if not ordered else "<ol>\n" if block.level == 1 else f'<ol start="{block.level}">\n')
        for b in block.blocks:
            _write(b, links, out, not loose, raw_html)
        out.append("</ol>\n" if ordered else "</ul>\n")
    else:
        for b in block.blocks:
            _write(b, links, out, False, raw_html)


def render(text: str, raw_html: bool = False) -> str:
    reader = Reader()
    page, out = reader.page(text), []
    _write(page, reader.links, out, False, raw_html)
    return "".join(out)


def commonmark_html(text: Column, raw_html: bool = False) -> Column:
    """HTML of CommonMark text."""

    def rendered(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else render(t, raw_html))

    return F.pandas_udf(rendered, "string")(text)
