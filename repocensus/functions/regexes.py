"""Catalogue regexes and globs as Java regular expressions (driver-side, per pattern)."""

from __future__ import annotations

import re

# A file name holding one of these is a regular expression, not a literal.
REGEX_SPECIALS = r"\.+*?()|[]{}^$"


def is_regex(text: str) -> bool:
    return any(ch in REGEX_SPECIALS for ch in text)


def java_regex(pattern: str) -> str:
    """Give a linear-engine (RE2 syntax) pattern the same meaning under java.util.regex.

    ``(?d)`` makes ``\\n`` the only line end; a bare ``$`` means end of text unless the
    pattern switches to multi-line mode; inside a class ``[`` and ``&&`` are literal.
    """
    multiline = re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    out, i, in_class, class_start = [], 0, False, -1
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            posix = re.match(r"\[:(\^?)(\w+):\]", pattern[i:])
            if posix:
                out.append(("\\P" if posix.group(1) else "\\p") + "{" + _POSIX[posix.group(2)] + "}")
                i += posix.end()
                continue
            if ch == "]" and i > class_start:
                in_class = False
            elif ch == "[" or (ch == "]" and i == class_start):
                ch = "\\" + ch
            elif ch == "&":
                ch = "\\&"
        elif ch == "[":
            in_class = True
            class_start = i + 2 if pattern[i + 1 : i + 2] == "^" else i + 1
        elif ch == "$" and not multiline:
            ch = r"\z"
        elif pattern.startswith("(?P<", i):
            ch, i = "(?<", i + 3
        out.append(ch)
        i += 1
    return "(?d)" + "".join(out)


_POSIX = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl",
    "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct",
    "space": "Space", "upper": "Upper", "xdigit": "XDigit",
}


def any_of(patterns: list[str]) -> str:
    """One alternation for an any-of list: a literal regex is compiled once per task."""
    return "|".join(f"(?:{p})" for p in patterns)


def glob_regex(glob: str) -> str:
    """Whole-string Java regex of a separator-free glob: ``*`` and ``**`` both cross '/'."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            while glob[i + 1 : i + 2] == "*":
                i += 1
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            negated = body.startswith("!")
            body = body[1:] if negated else body
            body = re.sub(r"([\\\[\]^&])", r"\\\1", body)
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        elif ch == "{":
            depth += 1
            out.append("(?:")
        elif ch == "}" and depth:
            depth -= 1
            out.append(")")
        elif ch == "," and depth:
            out.append("|")
        elif ch == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    return r"(?s)\A(?:" + "".join(out) + r")\z"


def needle(pattern: str) -> str:
    """A text every match of the pattern must contain; '' when none is obvious.

    Only patterns made of literals, escaped punctuation and (repeated) dots are looked
    into, which is what catalogues mostly consist of.
    """
    pieces, current, i = [], "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern) and not pattern[i + 1].isalnum():
            current, i = current + pattern[i + 1], i + 2
        elif ch == ".":
            pieces, current = pieces + [current], ""
            i += 2 if pattern[i + 1 : i + 2] in ("*", "+", "?") and i + 1 < len(pattern) else 1
        elif ch in REGEX_SPECIALS:
            return ""
        else:
            following = pattern[i + 1 : i + 2]
            if following and following in "*+?{":
                return ""
            current, i = current + ch, i + 1
    return max(pieces + [current], key=len)


def contains_any(texts: list[str]) -> str:
    """Java regex finding any of the given literal texts, sharing their common beginnings.

    Far cheaper than a flat alternation, which tries every text at every position.
    """
    root: dict = {}
    for text in texts:
        node = root
        for ch in text:
            node = node.setdefault(ch, {})
            if "" in node:  # a shorter text already decides
                break
        else:
            node.clear()
            node[""] = {}
    return _branches(root)


def _branches(node: dict) -> str:
    if not node or "" in node:
        return ""
    parts = [re.escape(ch) + _branches(rest) for ch, rest in sorted(node.items())]
    if len(parts) == 1:
        return parts[0]
    # one look at the next character instead of an attempt for each branch
    ahead = "(?=[" + "".join(map(re.escape, sorted(node))) + "])" if len(parts) > 3 else ""
    return ahead + "(?:" + "|".join(parts) + ")"
