"""Markdown documents to chunks, links and code: the per-document helper of the parsing stage.

A subset of CommonMark with tables: ATX and setext headings, fenced and indented code, paragraphs, block quotes, lists,
HTML blocks, reference definitions; code spans, links (inline, reference, autolinks), images, emphasis, escapes.

Kept on purpose: text outside headings, paragraphs and code (items of tight lists, table cells, raw HTML) is dropped;
soft line breaks vanish; a link stands as a node of its own before the node that holds its text; without a first-level
heading the first second-level one acts as the root; links and code are taken from each chunk's rebuilt text, parsed
again; offsets count the bytes of rebuilt lines.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from typing import NamedTuple


class Node(NamedTuple):
    kind: str  # heading, link, code, paragraph
    text: str
    #: A heading's level, a link's target, a code block's language.
    extra: object = None


#: Block quotes and lists, and images in images, that may stand in each other; what lies deeper is text.
MOST_NESTED, MOST_IMAGES = 100, 6


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^\n]*)$")
_ATX = re.compile(r" {0,3}(#{1,6})(?=[ \t]|$)")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
_FIRST_ITEM = re.compile(r" {0,3}(?:[-+*]|1[.)])[ \t]+\S")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}>")
_COLUMNS = re.compile(r"\|?[ \t]*:?-+:?(?:[ \t]*\|[ \t]*:?-+:?)*[ \t]*\|?$")
_DEFINITION = re.compile(r" {0,3}\[([^\]\[]+)\]:[ \t]*<?([^\s>]+)>?(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:[a-zA-Z/!?])")
_AUTOLINK = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*$")
_MAIL = re.compile(r"[\w.+-]+@[\w.-]+$")
_TAG = re.compile(r"/?[a-zA-Z][^<>]*$|!--")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);")
_PLAIN_TEXT, _TICKS, _RUNS = re.compile(r"[^\\`<\[\]()!*_~&\n]+"), re.compile("`+"), re.compile(r"\*+|_+|~+")
_LABEL = re.compile(r"\[([^\]]*)\]")
_TARGET = re.compile(r"\s*(?:<([^<>\n]*)>|([^\s<]\S*|))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*$")
#: Texts without code spans, links, tags, emphasis and entities: only escapes and line ends are to be taken away.
_EASY = re.compile(r"(?:[^\\`<\[*_~&]++|\\[\s\S])*+\\?")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~\n])|\n")
#: What links and code begin with.
_LINK_OR_CODE = re.compile(r"[\[<`\t]|~~~|    ")
#: Of CommonMark: the most characters of a reference's name.
_LONGEST_NAME = 999
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


class _Scan:
    """What one pass over a text tells: where code spans end, which brackets belong together, how long runs of marks are."""

    def __init__(self, text: str):
        self.span: dict[int, int] = {}  # start of a code span's opening run -> start of its closing run
        open_runs: dict[int, list[int]] = {}
        for m in _TICKS.finditer(text):
            open_runs.setdefault(len(m[0]), []).append(m.start())
        at = 0
        follow = {n: 0 for n in open_runs}
        ticks = sorted((s, n) for n, starts in open_runs.items() for s in starts)
        for start, n in ticks:
            if start < at or (start and text[start - 1] == "\\" and self._escapes(text, start)):
                continue
            starts, k = open_runs[n], follow[n]
            while k < len(starts) and starts[k] <= start:
                k += 1
            follow[n] = k
            if k < len(starts):
                self.span[start], at = starts[k], starts[k] + n
        self.closing: dict[int, int] = {}
        stacks: dict[str, list[int]] = {"]": [], ")": []}
        i = 0
        for m in re.finditer(r"\\|`+|[\[\]()]", text):
            if m.start() < i:
                continue
            c = m[0]
            if c == "\\":
                i = m.start() + 2
            elif c[0] == "`":
                i = self.span[m.start()] + len(c) if m.start() in self.span else m.end()
            elif c in "[(":
                stacks["]" if c == "[" else ")"].append(m.start())
            elif stacks[c]:
                self.closing[stacks[c].pop()] = m.start()
        self.runs: dict[str, list[int]] = {}
        for m in _RUNS.finditer(text):
            self.runs.setdefault(m[0][0], []).append(len(m[0]))
        for lengths in self.runs.values():
            lengths.sort()

    @staticmethod
    def _escapes(text: str, at: int) -> bool:
        """Whether the backslashes before ``at`` escape what stands there."""
        k = at
        while k and text[k - 1] == "\\":
            k -= 1
        return (at - k) % 2 == 1

    def elsewhere(self, mark: str, length: int) -> bool:
        """Whether another run of the mark is as long."""
        lengths = self.runs.get(mark, [])
        return len(lengths) - bisect_left(lengths, length) > 1


def _target(text: str, at: int, scan: _Scan) -> tuple[str, int] | None:
    """The destination of an inline link whose ``(`` is at ``at``, and the place after its ``)``."""
    end = scan.closing.get(at, -1)
    if end < 0:
        return None
    m = _TARGET.match(text, at + 1, end)
    return None if m is None else (_plain(m[1] if m[1] is not None else m[2] or ""), end + 1)


def _plain(text: str) -> str:
    return html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text))


def inline(text: str, references: dict[str, str], links: list[Node], inside: int = 0) -> str:
    """The text that a reader sees; links are added to ``links`` in the order in which they end.

    ``inside`` counts the labels around the text. The time is in proportion to its length.
    """
    if inside > MOST_IMAGES:  # what lies deeper is text
        return text
    if _EASY.fullmatch(text):
        return _ESCAPED.sub(lambda m: m[1] if m[1] and m[1] != "\n" else "", text)
    out, i, scan, angle = [], 0, _Scan(text), -1
    while i < len(text):
        m = _PLAIN_TEXT.match(text, i)
        if m:
            out.append(m[0])
            i = m.end()
            continue
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            out.append(text[i + 1] if text[i + 1] in _PUNCTUATION else "" if text[i + 1] == "\n" else "\\" + text[i + 1])
            i += 2
        elif c == "`":
            run = _TICKS.match(text, i)
            end = scan.span.get(i)
            if end is not None:
                code = text[run.end() : end].replace("\n", " ")
                out.append(code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip() else code)
                i = end + len(run[0])
            else:
                out.append(run[0])
                i = run.end()
        elif c == "<":
            if angle < i:  # looked for once for all that stands before it
                angle = text.find(">", i)
                angle = len(text) if angle < 0 else angle
            closed = angle < len(text) and (text.startswith("<!--", i) or text.find("<", i + 1, angle) < 0)
            body = text[i + 1 : angle] if closed else ""
            if body and (_AUTOLINK.match(body) or _MAIL.match(body)):
                links.append(Node("link", body, body if ":" in body else f"mailto:{body}"))
                out.append(body)
                i = angle + 1
            elif body and _TAG.match(body):
                i = angle + 1
            else:
                out.append(c)
                i += 1
        elif c == "[" or (c == "!" and text[i + 1 : i + 2] == "["):
            image = c == "!"
            at = i + image
            end = scan.closing.get(at, -1)
            target, after = None, end + 1
            if end > 0 and text[after : after + 1] == "(":
                found = _target(text, after, scan)
                if found:
                    target, after = found
            if end > 0 and target is None and references:
                m = _LABEL.match(text, end + 1)
                name = m[1] if m and m[1] else text[at + 1 : end] if end - at <= _LONGEST_NAME else ""
                name = " ".join(name.lower().split())
                if name in references:
                    target, after = references[name], m.end() if m else end + 1
            if target is not None and not (inside and not image):
                shown = inline(text[at + 1 : end], references, links, inside + 1)
                out.append(shown)
                if not image:
                    links.append(Node("link", shown, target))
                i = after
            else:
                out.append(text[i : at + 1])
                i = at + 1
        elif c in "*_~":
            run = _RUNS.match(text, i)[0]
            before, after = text[i - 1 : i] if i else " ", text[i + len(run) : i + len(run) + 1] or " "
            lone = (before.isspace() and after.isspace()) or (c == "_" and before.isalnum() and after.isalnum()) or (c == "~" and len(run) > 2)
            out.append(run if lone or not scan.elsewhere(c, len(run)) else "")
            i += len(run)
        elif c == "&":
            m = _ENTITY.match(text, i)
            out.append(html.unescape(m[0]) if m else c)
            i = m.end() if m else i + 1
        elif c == "\n":
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _is_rule(line: str) -> bool:
    marks = line.replace(" ", "").replace("\t", "") if line.lstrip(" ")[:1] in ("-", "*", "_") and not line.strip("-*_ \t") else ""
    return len(marks) > 2 and marks == marks[0] * len(marks) and not line.startswith("    ")


def _atx(line: str) -> tuple[int, str] | None:
    """Level and text of an ATX heading."""
    m = _ATX.match(line)
    if not m:
        return None
    text = line[m.end() :].strip(" \t")
    bare = text.rstrip("#")
    return len(m[1]), bare.rstrip(" \t") if not bare or bare[-1] in " \t" else text


def _blocks(lines: list[str], references: dict[str, str], nodes: list[Node], paragraphs: bool = True, depth: int = 0) -> None:
    """Appends the nodes of ``lines``; without ``paragraphs`` plain text is dropped (but its links stay)."""
    def text_node(kind: str, text: str, level: int | None = None) -> None:
        links: list[Node] = []
        shown = inline(text, references, links)
        nodes.extend(links)
        if kind == "heading":
            nodes.append(Node("heading", shown, level))
        elif paragraphs and shown.strip():
            nodes.append(Node("paragraph", shown.strip()))

    if depth > MOST_NESTED:  # what lies deeper is text
        for line in lines:
            if line.strip():
                text_node("paragraph", line.strip())
        return

    i, held = 0, []

    def flush() -> None:
        if held:
            text_node("paragraph", "\n".join(x.strip() for x in held))
            held.clear()

    while i < len(lines):
        line = lines[i]
        if not line.strip():
            flush()
            i += 1
            continue
        fence, atx = _FENCE.match(line), _atx(line)
        if fence and not (fence[1][0] == "`" and "`" in fence[2]):
            flush()
            indent, body, i = len(line) - len(line.lstrip(" ")), [], i + 1
            close = re.compile(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$")
            while i < len(lines) and not close.match(lines[i]):
                body.append(re.sub(rf"^ {{0,{indent}}}", "", lines[i]))
                i += 1
            nodes.append(Node("code", "\n".join(body).rstrip("\n"), fence[2].strip() or None))
            i += 1
        elif atx:
            flush()
            text_node("heading", atx[1], atx[0])
            i += 1
        elif held and _UNDERLINE.match(line):
            text = "\n".join(x.strip() for x in held)
            held.clear()
            text_node("heading", text, 1 if "=" in line else 2)
            i += 1
        elif _is_rule(line):
            flush()
            i += 1
        elif line.startswith(("    ", "\t")) and not held:
            body = []
            while i < len(lines) and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                body.append(lines[i][1:] if lines[i].startswith("\t") else lines[i][4:])
                i += 1
            nodes.append(Node("code", "\n".join(body).rstrip("\n"), None))
        elif _QUOTE.match(line):
            flush()
            inner = []
            while i < len(lines) and lines[i].strip() and (_QUOTE.match(lines[i]) or inner):
                inner.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                i += 1
            _blocks(inner, references, nodes, paragraphs, depth + 1)
        elif _ITEM.match(line) and not (held and not _FIRST_ITEM.match(line)):
            flush()
            i = _list(lines, i, references, nodes, depth)
        elif _HTML.match(line) and not held and not _AUTOLINK.match(line.strip()[1:].split(">")[0]):
            while i < len(lines) and lines[i].strip():
                i += 1
        elif not held and "|" in line and i + 1 < len(lines) and "|" in lines[i + 1] and not lines[i + 1].startswith(("    ", "\t")) and _COLUMNS.match(lines[i + 1].strip()):
            while i < len(lines) and lines[i].strip():
                for cell in lines[i].strip().strip("|").split("|"):
                    inline(cell, references, nodes)  # links only
                i += 1
        elif not held and _DEFINITION.match(line):
            i += 1
        else:
            held.append(line)
            i += 1
    flush()


def _list(lines: list[str], i: int, references: dict[str, str], nodes: list[Node], depth: int) -> int:
    """One list from line ``i``; returns the line after it. The paragraphs of a tight list are dropped."""
    items, loose = [], False
    while i < len(lines):
        m = _ITEM.match(lines[i])
        if not m or _is_rule(lines[i]):
            break
        width = len(m[0]) if m[3].strip(" \t") == "" and 0 < len(m[3]) <= 4 else len(m[1]) + len(m[2]) + 1
        item, i = [lines[i][width:]], i + 1
        while i < len(lines):
            if not lines[i].strip():
                next_ = i + 1
                while next_ < len(lines) and not lines[next_].strip():
                    next_ += 1
                ahead = lines[next_] if next_ < len(lines) else ""
                if not (ahead.startswith(" " * width) or _ITEM.match(ahead)):
                    break
                loose = True
                item += [""] * (next_ - i)
                i = next_
                continue
            elif lines[i].startswith(" " * width):
                item.append(lines[i][width:])
            elif _ITEM.match(lines[i]) or not item[-1].strip() or _ATX.match(lines[i]) or _FENCE.match(lines[i]):
                break
            else:
                item.append(lines[i])
            i += 1
        items.append(item)
    for item in items:
        _blocks(item, references, nodes, loose, depth + 1)
    return i


def nodes_of(markdown: str) -> list[Node]:
    lines = markdown.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    references: dict[str, str] = {}
    for line in lines:
        m = _DEFINITION.match(line)
        if m:
            references.setdefault(" ".join(m[1].lower().split()), _plain(m[2]))
    out: list[Node] = []
    _blocks(lines, references, out)
    return out


def _line(node: Node) -> str:
    if node.kind == "heading":
        return f"{'#' * node.extra} {node.text}"
    if node.kind == "link":
        return f"[{node.text}]({node.extra})"
    return f"```{node.extra or ''}\n{node.text}\n```" if node.kind == "code" else node.text


def _hash(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def chunk_nodes(nodes: list[Node], source_id: str, path: str) -> list[dict]:
    """Chunks bounded by headings of the first three levels; empty ones are left out."""
    chunks, lines, headings, offset = [], [], [], 0

    def flush() -> None:
        nonlocal offset
        content = "\n".join(lines).rstrip()
        if content:
            chunks.append({"chunk_id": _hash(content, source_id, path), "position": len(chunks), "char_offset": offset, "heading_hierarchy": list(headings), "content": content})
            offset += sum(len(x.encode()) + 1 for x in lines)
        lines.clear()

    for node in nodes:
        if node.kind == "heading" and node.extra <= 3:
            flush()
            headings[node.extra - 1 :] = [node.text]
        lines.append(_line(node))
    flush()
    return chunks


def parse_body(body: str, source_id: str, path: str) -> tuple[list[dict], list[dict], list[dict], str | None]:
    """Chunks, links and code of a document, and its first heading of the first level."""
    nodes = nodes_of(body)
    chunks, links, code = chunk_nodes(nodes, source_id, path), [], []
    for chunk in chunks:
        own = chunk["chunk_id"]
        if not _LINK_OR_CODE.search(chunk["content"]):
            continue
        for node in nodes_of(chunk["content"]):
            if node.kind == "link":
                target, _, anchor = node.extra.partition("#")
                links.append({"src_chunk_id": own, "target_path": target, "link_text": node.text, "anchor": anchor or None})
            elif node.kind == "code":
                code.append({"snippet_id": _hash(own, node.extra or "", node.text, "code-snippet", own), "chunk_id": own, "language": node.extra, "content": node.text})
    return chunks, links, code, next((n.text for n in nodes if n.kind == "heading" and n.extra == 1), None)
