"""Style sheets by the tokens of CSS Syntax level 3, in one pass: what makes a browser run or send something, and the rule around it.

Tokens come from one pattern, so strings, addresses, comments and escapes are told as a browser tells them, and every character is
looked at a bounded number of times. A stack of open brackets gives the rules: a prelude up to ``;`` or its block; blocks of grouping
rules hold rules again, all other blocks belong to their rule. A second, coarse reading takes comments out wherever they seem to
be, as old engines did; where it finds what the tokens don't show, the readings disagree and the whole sheet counts.
"""

from __future__ import annotations

import re

# Names of properties and functions that run something, rules whose blocks hold rules, types that run as data.
SCRIPTING = ("expression", "-moz-binding", "behavior")
GROUPING = ("media", "supports", "document", "layer", "container", "scope")
ACTIVE_TYPES = ("text/html", "application/xhtml+xml", "image/svg+xml", "text/javascript", "application/javascript", "application/ecmascript")
#: Functions whose value is loaded.
LOADING = ("url", "src", "image-set", "-webkit-image-set")

_ESCAPE = r"\\(?:[0-9a-fA-F]{1,6}(?:\r\n|[ \t\n\r\f])?|[^\n\r\f0-9a-fA-F]|\Z)"
_LETTER = rf"(?:[A-Za-z_\0\x80-\U0010FFFF]|{_ESCAPE})"
_NAME = rf"(?:[A-Za-z0-9_\-\0\x80-\U0010FFFF]++|{_ESCAPE})"
_IDENT = rf"(?:(?:--|-?{_LETTER}){_NAME}*+)"
_STRING = r"(?:[^{0}\\\n\r\f]++|\\(?:\r\n|[\s\S]|\Z))*+"
_TOKEN = re.compile("|".join((
    r"(?P<space>[ \t\n\r\f]++|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z))",
    rf"(?P<string>\"{_STRING.format(chr(34))}(?:\"|(?=[\n\r\f])|\Z)|'{_STRING.format(chr(39))}(?:'|(?=[\n\r\f])|\Z))",
    rf"(?P<number>[+-]?(?:[0-9]++(?:\.[0-9]++)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?(?:%|{_IDENT})?)",
    r"(?P<other>-->|[,:.>+~|!/%&?=`-]{2,64}(?<!-))",
    rf"(?P<at>@{_IDENT})", rf"(?P<hash>#{_NAME}++)", rf"(?P<name>{_IDENT}\(?)",
    r"(?P<match>[\^$*]=)", r"(?P<open>[({\[])", r"(?P<close>[)}\]])", r"(?P<end>;++)", r"(?P<delimiter>[\s\S])")))
_ADDRESS = re.compile(rf"[ \t\n\r\f]*+((?:[^\"'()\\ \t\n\r\f\x00-\x08\x0b\x0e-\x1f\x7f]++|{_ESCAPE})*+)[ \t\n\r\f]*+(?:\)|\Z)")
_BAD_ADDRESS = re.compile(r"((?:[^)\\]++|\\(?:[\s\S]|\Z))*+)\)?")
_QUOTED = re.compile(r"[ \t\n\r\f]*+[\"']")
_UNESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})(?:\r\n|[ \t\n\r\f])?|(\r\n|[\n\r\f])|([\s\S])|\Z)")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_CLOSER = {"(": ")", "[": "]", "{": "}"}


def unescaped(text: str) -> str:
    """A name, string or address as it reads: escapes resolved, lines joined at an escaped line end."""
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[1]:
            code = int(m[1], 16)
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
        return "" if m[2] else m[3] or "�"

    return _UNESCAPE.sub(one, text)


def is_dangerous(value: str) -> bool:
    """Whether an address, blanks and control characters taken out, runs a script."""
    if ":" not in value:
        return False
    bare = "".join(c for c in value[:4096] if not c.isspace() and not "\x00" <= c < "\x20" and not "\x7f" <= c < "\xa0").lower()
    return bare.startswith("javascript:") or (bare.startswith("data:") and bare[5:].startswith(ACTIVE_TYPES))


class _Rule:
    """An open rule: where it begins, its at-keyword, what its prelude probes and its values load, and its findings."""

    __slots__ = ("at_rule", "begin", "hits", "loads", "probes")

    def __init__(self, begin: int):
        self.begin, self.at_rule, self.probes, self.loads, self.hits = begin, "", False, False, []


def tokenized_findings(text: str) -> list[tuple[str, int, tuple[int, int]]]:
    """(rule, place, range of the rule around it): imports, scripting names, active addresses, and rules that probe parts of attributes
    and load something."""
    out: list[tuple[str, int, tuple[int, int]]] = []
    rules: list[_Rule | None] = [None]  # the open rule of each level of rules
    brackets: list[tuple[str, str]] = []  # what closes each open bracket, and what it holds: values, a rule's block, rules
    match, at, n = _TOKEN.match, 0, len(text)

    def finish(end: int) -> None:
        rule = rules[-1]
        if rule is not None:
            if rule.probes and rule.loads:
                out.append(("scan.css.exfiltration", rule.begin, (rule.begin, end)))
            out.extend((name, place, (rule.begin, end)) for name, place in rule.hits)
            rules[-1] = None

    while at < n:
        token = match(text, at)
        kind, begin, at = token.lastgroup, at, token.end()
        if kind == "space":
            continue
        level = brackets[-1] if brackets else None
        if kind == "close" and level and token[0] == level[0]:
            brackets.pop()
            if level[1] == "rules":
                finish(begin)
                rules.pop()
            if level[1] != "values":
                finish(at)
            continue
        rule = rules[-1]
        if rule is None:
            rule = rules[-1] = _Rule(begin)
        if kind == "name":
            call = token[0][-1] == "("
            name = unescaped(token[0][:-1] if call else token[0]).lower()
            if name in SCRIPTING:
                rule.hits.append(("scan.css.expression", begin))
            if call and name == "url" and not _QUOTED.match(text, at):
                rule.loads = True
                value = _ADDRESS.match(text, at) or _BAD_ADDRESS.match(text, at)
                at = value.end()
                if is_dangerous(unescaped(value[1]).lstrip("\"' \t\n\r\f")):
                    rule.hits.append(("scan.css.dangerous_scheme", begin))
            elif call:
                rule.loads = rule.loads or name in LOADING
                brackets.append((")", "values"))
        elif kind == "string":
            if is_dangerous(unescaped(token[0][1:])):
                rule.hits.append(("scan.css.dangerous_scheme", begin))
        elif kind == "at":
            name = unescaped(token[0][1:]).lower()
            if name == "import":
                rule.hits.append(("scan.css.import", begin))
            if level is None or level[1] == "rules":
                rule.at_rule = name
        elif kind == "match":
            rule.probes = True
        elif kind == "open":
            if token[0] == "{" and (level is None or level[1] == "rules"):
                grouping = rule.at_rule in GROUPING
                brackets.append(("}", "rules" if grouping else "block"))
                if grouping:
                    rules.append(None)
            else:
                brackets.append((_CLOSER[token[0]], "values"))
        elif kind == "end" and (level is None or level[1] == "rules"):
            finish(at)
    while rules:
        finish(n)
        rules.pop()
    return out


def _coarse(text: str) -> bool:
    """Whether a scripting name stands anywhere once comments are out, whatever strings they are in."""
    bare = _COMMENT.sub("", text).lower() if "/*" in text else text.lower()
    return any(name in bare for name in SCRIPTING)


def css_findings(text: str) -> list[tuple[str, int, tuple[int, int]]]:
    """(rule, place, range of the rule around it), in order of places. Linear but for sorting.

    If tokens show nothing that runs but the coarse reading does, that is a finding of the whole sheet.
    """
    found = tokenized_findings(text)
    if all(rule != "scan.css.expression" for rule, *_ in found) and _coarse(text):
        found.append(("scan.css.expression", 0, (0, len(text))))
    return sorted(found, key=lambda x: x[1])


def rewritten_css(text: str) -> str:
    """The text without the rules that have findings. Rules end where others begin, so what is left has the same tokens; if the coarse
    reading still finds something in it, nothing is left."""
    out, at = [], 0
    for a, b in sorted({span for _, _, span in css_findings(text)}):
        out.append(text[at : max(a, at)])
        at = max(at, b)
    kept = "".join(out) + text[at:]
    return "" if at and _coarse(kept) else kept


def sheet_encoding(data: bytes) -> tuple[str, int]:
    """(encoding, bytes of the mark before the text): UTF-16 where a byte order mark says so, else UTF-8."""
    if data.startswith(b"\xff\xfe"):
        return "utf-16-le", 2
    if data.startswith(b"\xfe\xff"):
        return "utf-16-be", 2
    return "utf-8", 0


def sheet_places(data: bytes) -> list[tuple[str, int]]:
    """(rule, place in bytes) of a sheet's findings."""
    encoding, mark = sheet_encoding(data)
    text = data[mark:].decode(encoding, "replace")
    out, at, total = [], 0, mark
    for rule, place, _ in css_findings(text):
        total += place - at if encoding == "utf-8" and text.isascii() else len(text[at:place].encode(encoding, "replace"))
        at = place
        out.append((rule, total))
    return out


def rewritten_sheet(data: bytes) -> bytes:
    """A sheet without the rules that have findings, in its own encoding."""
    encoding, mark = sheet_encoding(data)
    how = "surrogateescape" if encoding == "utf-8" else "surrogatepass"
    try:
        return data[:mark] + rewritten_css(data[mark:].decode(encoding, how)).encode(encoding, how)
    except UnicodeDecodeError:  # half a UTF-16 unit at the end
        return rewritten_sheet(data[:-1])
