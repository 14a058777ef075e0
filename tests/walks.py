"""Plain-Python sequential walks used as brute-force checks in the tests.

They follow the documented behaviour one character or one queue item at a
time, the way a single-document reader would, so the set-based Spark plans
can be compared against them on small inputs.
"""

from __future__ import annotations

import re

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:"[^"]*"|'[^']*'|[^>])*)>""")
MAIN = re.compile(r"<(main|article|h1)(?![A-Za-z0-9_])", re.I)


def strip_spans(html: str, is_chrome) -> tuple[str, int, int, str | None]:
    """Walk tags in order with one drop state; returns (kept html, cuts,
    kept, unclosed tag)."""
    cuts, kept, drop = [], 0, None
    for m in TAG.finditer(html):
        closing, tag, attrs = m.group(1) == "/", m.group(2).lower(), m.group(3)
        self_closing = tag in VOID or re.search(r"/\s*$", attrs) is not None
        if drop is not None:
            if tag != drop[0]:
                continue
            if closing:
                drop[2] -= 1
                if drop[2] == 0:
                    if MAIN.search(html[drop[1]:m.end()]):
                        kept += 1
                    else:
                        cuts.append((drop[1], m.end()))
                    drop = None
            elif not self_closing:
                drop[2] += 1
            continue
        if closing or self_closing:
            continue
        if is_chrome(tag, attrs):
            drop = [tag, m.start(), 1]
    out, cur = [], 0
    for a, b in cuts:
        out.append(html[cur:a])
        cur = b
    out.append(html[cur:])
    return "".join(out), len(cuts), kept, (drop[0] if drop else None)


def bfs(start: str, pages: dict[str, list[str]], budget: int, leads: dict[str, str | None] | None = None) -> dict:
    """FIFO walk: pages maps path -> linked paths (missing path = failure);
    leads maps a redirecting path to where it ends (None: another site)."""
    queue, seen, attempted, mapped, failed, done = [start], {start}, 0, [], [], set()
    while queue and attempted < budget:
        cur = queue.pop(0)
        attempted += 1
        end = (leads or {}).get(cur, cur)
        if end is None or end in done:
            continue
        if end not in pages:
            failed.append(cur)
            continue
        done.add(end)
        mapped.append(cur)
        for t in pages[end]:
            if t not in seen:
                seen.add(t)
                queue.append(t)
    return {"attempted": attempted, "mapped": mapped, "failed": failed, "left": len(queue)}
