"""Leaf blocks of an HTML page, and the features by which they are labelled."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# fixed values: HTML elements by what they do to the flow of text
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT_TAGS = frozenset("button canvas datalist embed head iframe noscript object option script select style svg template textarea title video audio".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_TAGS = frozenset("html head base link meta title style script noscript template".split())
FLAT_TAGS = frozenset("button datalist head option select".split())  # silent tags that do not nest
CLOSED_BY = {
    "p": BLOCK_TAGS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
SCOPES = frozenset("ul ol dl table menu dir".split())

TAG = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*+>?|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW_TAGS}


class Block(NamedTuple):
    """A run of text between block tags: where it stands, what it says, how many of its characters are links."""

    path: tuple[tuple[str, str], ...]  # (tag, names) from the root
    text: str
    linked: int


class Tag(NamedTuple):
    name: str
    ends: bool
    more: str
    empty: bool


def _tokens(page: str) -> list[tuple[str, Tag | None]]:
    """Each run of text with the tag after it, without comments and the contents of raw elements."""
    out: list[tuple[str, Tag | None]] = []
    at = 0
    while True:
        tag = TAG.search(page, at)
        piece = page[at : tag.start() if tag else len(page)]
        name = (tag[2] or tag[5] or "").lower() if tag else ""
        if not name:
            out.append((piece, None))
        if not tag:
            return out
        at = tag.end()
        if name:
            ends, more = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
            if name in RAW_TAGS and not ends:
                end = RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            out.append((piece, Tag(name, ends, more, name in VOID_TAGS or (tag[3] or "").endswith("/"))))


def _ended(tokens: list[tuple[str, Tag | None]]) -> set[int]:
    """The places of silent start tags that have an end tag of their own."""
    found: set[int] = set()
    opened: dict[str, list[int]] = {}
    for k, (_, tag) in enumerate(tokens):
        if tag and tag.name in SILENT_TAGS and not tag.empty:
            held = opened.setdefault(tag.name, [])
            if not tag.ends:
                if tag.name in FLAT_TAGS:
                    held.clear()
                held.append(k)
            elif held:
                found.add(held.pop())
    return found


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order. White space inside a block is one blank; character references are decoded.

    Silent elements end with their end tag, with that of an element around them, or, if theirs is left out, with the next block tag;
    an option also with the next option, a button or select with the next of its kind, and the head with the first text or tag of the body.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    silent: list[tuple[str, bool]] = []  # the open silent element and all in it, each with whether its end is known
    parts: list[str] = []
    linked, in_link = 0, 0
    tokens = _tokens(page)
    ended = _ended(tokens)

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(stack), text, linked))
            parts.clear()
        linked = 0

    for k, (piece, tag) in enumerate(tokens):
        if silent and silent[-1][0] == "head" and (piece.strip() or (tag and not tag.ends and tag.name not in HEAD_TAGS)):
            silent.pop()
        if piece and not silent:
            piece = html.unescape(piece)
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if not tag:
            continue
        name, ends = tag.name, tag.ends
        if silent and name in BLOCK_TAGS:
            while silent and not silent[-1][1]:
                silent.pop()
            if name == "body" and not ends:
                silent.clear()
        if silent and not ends and name in FLAT_TAGS | {"optgroup"}:
            kind = "option" if name == "optgroup" else name
            for j in range(len(silent) - 1, -1, -1):
                if silent[j][0] == kind:
                    del silent[j:]
                    break
        if silent and ends:
            j = max((j for j, (held, _) in enumerate(silent) if held == name), default=-1)
            if j >= 0:
                del silent[j:]
                if not silent:
                    parts.append(" ")
                continue
            if name in BLOCK_TAGS and any(held == name for held, _ in stack):
                silent.clear()
        if name in SILENT_TAGS:
            if not ends and name not in RAW_TAGS and not tag.empty:
                silent.append((name, k in ended))
            if not silent:
                parts.append(" ")
            continue
        if silent:
            if name in BLOCK_TAGS and not ends and not tag.empty:
                silent.append((name, True))
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = 0 if ends else 1
        elif name in BLOCK_TAGS:
            close()
            in_link = 0
            if ends:
                for j in range(len(stack) - 1, -1, -1):
                    if stack[j][0] == name:
                        del stack[j:]
                        break
            elif name not in VOID_TAGS:
                for j in range(len(stack) - 1, -1, -1):
                    if name in CLOSED_BY.get(stack[j][0], ()):
                        del stack[j:]
                        break
                    if stack[j][0] in SCOPES:
                        break
                names = " ".join(a or b or c for a, b, c in NAMES.findall(tag.more)).lower()
                stack.append((name, " ".join(PART.findall(names))))
    close()
    return out


def path_features(path: tuple[tuple[str, str], ...]) -> list[str]:
    """Tags and names of the ancestors; the nearest two also by their place."""
    out = {f"in:{tag}" for tag, _ in path} | {f"name:{part}" for _, names in path for part in names.split()}
    if path:
        out.add(f"own:{path[-1][0]}")
        out |= {f"ownname:{part}" for part in path[-1][1].split()}
    if len(path) > 1:
        out |= {f"up:{path[-2][0]}", f"pair:{path[-2][0]}>{path[-1][0]}"}
    return sorted(out)


def _step(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= e for e in edges)


END_MARKS = (".", "!", "?", ":", "…", ".”", '."')


def text_features(block: Block, k: int, n: int) -> tuple[str, ...]:
    """Length, link share, punctuation, place and the number of blocks on the page, each in a few steps."""
    text = block.text
    words = text.count(" ") + 1
    share = block.linked / len(text)
    return (
        f"words:{_step(words, (3, 6, 12, 25, 60))}",
        f"links:{_step(share, (0.01, 0.3, 0.7))}",
        f"ends:{text.endswith(END_MARKS)}",
        f"commas:{_step(text.count(','), (1, 3))}",
        f"sign:{'©' in text or '·' in text or '|' in text or '»' in text}",
        f"place:{_step(k / n, (0.1, 0.3, 0.7, 0.9))}",
        f"short:{words < 6 and not text.endswith(END_MARKS)}",
        f"blocks:{_step(n, (2, 4, 8))}",
    )
