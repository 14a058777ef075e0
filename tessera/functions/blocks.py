"""Folds over one file's lines: the blocks that its headers open, with their last lines.

Small per-file helpers for Arrow tasks. A file comes as its text and its "clean" text
(comments and strings rewritten, the same line breaks); a block goes out as
(kind, name, first line, last line). One pass over the lines, with a stack of the
blocks that are still open; brackets are counted only where a block waits for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa

from tessera.functions.text import WS, WS_CHARS

#: Where a Java pattern's '.' and '$' stop.
_LINE_ENDS = "\n\r\x85  "
_MASK = re.compile(f"[^{_LINE_ENDS}]*\x01([0-9]+)\x02")
Block = tuple[str, str, int, int]
#: What a Python header begins with: "async", "class" or "def".
_HEADER_STARTS = frozenset("acd")


def compiled(pattern: str) -> re.Pattern:
    """A line pattern written for Java's regular expressions."""
    out = pattern.replace(WS, "[" + re.escape(WS_CHARS) + "]")
    return re.compile(out[:-1] + r"(?:\r\n|[\n\r\x85  ])?\Z" if out.endswith("$") else out)


def lexer(lex: str) -> re.Pattern:
    """A lexing pattern written for Java, without the look ahead at a token's first character."""
    return re.compile(lex[lex.index(")") + 1:].replace(r"\z", r"\Z").replace(r"\\.", rf"\\[^{_LINE_ENDS}]"))


def python_token(token: re.Match) -> str:
    """A comment is dropped; a string becomes a quote and its line breaks, a triple-quoted one of several lines a mask."""
    t = token[0]
    if t[0] == "#":
        return ""
    n = t.count("\n")
    if not n:
        return '"'
    return (f"\x01{n}\x02" if t.startswith(('"""', "'''")) else '"') + "\n" * n


def js_token(token: re.Match) -> str:
    """A comment is dropped but for its line breaks; a string becomes its quote."""
    t = token[0]
    return t[0] if t[0] != "/" else "\n" * t.count("\n")


def text_lines(text: str) -> list[str]:
    """``split_lines`` of a text."""
    out = text.replace("\r\n", "\n").split("\n")
    return out[:-1] if out[-1] == "" else out


def trimmed(line: str) -> str:
    """Without the whitespace in front (plain spaces, the usual indent, first)."""
    out = line.lstrip(" ")
    return out if not out or "\r" < out[0] < "\xa0" else out.lstrip(WS_CHARS)


def _balance(line: str) -> int:
    """Opening minus closing brackets."""
    return line.count("(") + line.count("[") + line.count("{") - line.count(")") - line.count("]") - line.count("}")


def indent_blocks(text: str, clean: str, headers: list[tuple[str, re.Pattern, int]]) -> list[Block]:
    """Python: a signature ends with the ':' that finds its brackets closed, a block with
    its last code or string line that is indented further than its header."""
    mask_end, depth, last, top = 0, 0, None, -1
    heads: list[tuple] = []  # kind, name, line, indent, bracket depth before it (from the first one that waits)
    opened: list[tuple] = []  # kind, name, line, indent, last line of the signature
    done: list[Block] = []
    lines = text_lines(text)
    masks = "\x01" in clean
    for i, (raw, line) in enumerate(zip(lines, clean.split("\n")), 1):
        body = raw.lstrip(" ")
        if body and not "\r" < body[0] < "\xa0":
            body = body.lstrip(WS_CHARS)
        masked = mask_end >= i  # begins within a string
        if masks and "\x01" in line and (found := _MASK.match(line)):
            mask_end = max(mask_end, i + int(found[1]))
        before = depth
        if heads:
            depth += _balance(line)
        if body and not masked:
            start = body[0]
            if start != "#" and opened and (indent := len(raw) - len(body)) <= top:
                top = -1
                for s in opened:
                    if s[3] >= indent:
                        done.append((s[0], s[1], s[2], last if last and last > s[4] else s[4]))
                    elif s[3] > top:
                        top = s[3]
                opened = [s for s in opened if s[3] < indent] if top >= 0 else []
            if start in _HEADER_STARTS:
                for kind, pattern, group in headers:
                    if kind in body and (found := pattern.match(raw)):
                        if not heads:
                            before, depth = 0, _balance(line)
                        heads.append((kind, found[group], i, len(raw) - len(body), before))
                        break
            if start != "#":
                last = i
        elif masked:
            last = i
        if heads and ":" in line:
            # a statement behind the ':' makes the block one line
            alone = not line.endswith(":") and trimmed(line.rpartition(":")[2]) != ""
            for kind, name, st, at, outer in heads:
                if depth <= outer and alone:
                    done.append((kind, name, st, i))
                elif depth <= outer:
                    opened.append((kind, name, st, at, i))
                    top = max(top, at)
            heads = [s for s in heads if depth > s[4]]
    done += [(k, n, st, max(sig, last or sig)) for k, n, st, _, sig in opened]
    return done + [(k, n, st, len(lines)) for k, n, st, _, _ in heads]


def brace_blocks(text: str, clean: str, headers: list[tuple[str, re.Pattern, str, str]], lookahead: int) -> list[Block]:
    """JavaScript: a block ends where the braces are back at its header's depth, but not
    behind '=>'; one without a brace within ``lookahead`` lines is an expression up to ';', or its header."""
    depth, top = 0, None
    waiting: list[tuple] = []  # kind, name, line, brace depth before it; no brace so far
    opened: list[tuple] = []
    done: list[Block] = []
    lines = text_lines(text)
    for i, (raw, line) in enumerate(zip(lines, clean.split("\n")), 1):
        opens = "{" in line
        before = depth
        if opens:
            depth += line.count("{")
        if "}" in line:
            depth -= line.count("}")
        if "(" in raw or "=" in raw or "class" in raw or "function" in raw:
            for kind, pattern, first, second in headers:
                if first in raw and second in raw and (found := pattern.match(raw)):
                    waiting.append((kind, found[1], i, before))
                    break
        if waiting:
            semi = not opens and ";" in line and line.rstrip(WS_CHARS).endswith(";")
            still = []
            for s in waiting:
                kind, name, st, at = s
                near = i <= st + lookahead
                if opens and near:
                    opened.append(s)
                    top = at if top is None else max(top, at)
                elif not opens and semi and depth <= at and near:
                    done.append((kind, name, st, i))
                elif opens or i >= st + lookahead:
                    done.append((kind, name, st, st))
                else:
                    still.append(s)
            waiting = still
        if top is not None and depth <= top:
            end = line.rstrip(WS_CHARS) if ">" in line else ""
            if not (end.endswith(">") and end[:-1].rstrip(WS_CHARS).endswith("=")):
                top = None
                for s in opened:
                    if depth <= s[3]:
                        done.append((s[0], s[1], s[2], i))
                    elif top is None or s[3] > top:
                        top = s[3]
                opened = [s for s in opened if depth > s[3]] if top is not None else []
    return done + [(k, n, st, len(lines)) for k, n, st, _ in opened] + [(k, n, st, st) for k, n, st, _ in waiting]


def nested(symbols: Iterable[tuple]) -> list[tuple]:
    """The symbols (kind, name, first line, last line) of one file in line order, each with its
    depth and its parent's first line.

    They are folded over the stack of earlier ones: those that end before a symbol's line can't
    cover it or any later one, so what is on top after dropping them is the parent, whether or
    not ranges cross. ``low`` is the smallest end on the stack: nothing is dropped before that
    line is passed."""
    stack: list[tuple] = []  # first line, last line, depth
    low = None
    out = []
    for kind, name, start, end in symbols:
        if low is not None and start is not None and start > low:
            stack = [p for p in stack if p[1] >= start]
            low = min((p[1] for p in stack), default=None)
        parent, _, depth = stack[-1] if stack else (None, None, 0)
        out.append((kind, name, start, end, depth + 1, parent))
        if start is not None and end is not None and end > start:
            stack.append((start, end, depth + 1))
            low = end if low is None else min(low, end)
    return out


#: Columns of a symbol; a nested one has all six.
TYPES = {"kind": pa.string(), "name": pa.string(), "start_line": pa.int32(), "end_line": pa.int32(), "depth": pa.int32(), "parent_start": pa.int32()}


def symbol_rows(ids: pa.Array, found: list[list[tuple]], width: int) -> pa.RecordBatch:
    """One row a symbol, with its file's id."""
    names = list(TYPES)[:width]
    columns = list(zip(*chain.from_iterable(found))) or [()] * width
    owner = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
    return pa.RecordBatch.from_arrays([ids.take(owner), *(pa.array(c, TYPES[n]) for c, n in zip(columns, names))], names=["file_id", *names])
