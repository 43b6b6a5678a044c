"""TeX markup read as text: what a reader sees, and what is commented out."""

from __future__ import annotations

import re
import unicodedata

#: Combining marks of the accent commands, and letters that have a command of their own.
ACCENTS = {"^": "\u0302", "'": "\u0301", '"': "\u0308", "`": "\u0300", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a"}
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "i", "j": "j"}

_BODY = r"\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
_DEFINITION = re.compile(r"\\(?:(?:re)?newcommand\*?\s*\{?\s*\\([A-Za-z]+)\s*\}?|def\s*\\([A-Za-z]+))\s*(?:\[\d\])?(?:\[[^\]]*\])?(?:#\d)*\s*" + _BODY)
_COMMENT = re.compile(r"(?<!\\)((?:\\\\)*)%[^\n]*(?:\n[ \t]*)?")
_NO_SHARE = re.compile(r"(?<![\d\\])(?<!\d )%[^\n]*(?:\n[ \t]*)?")
_COMMANDS = re.compile(r"\\(?:begin|iffalse|documentclass|usepackage|(?:sub)*section|cite|ref|label|input|include|emph|newcommand|def)(?![A-Za-z])")
_SKIPPED = re.compile(r"\\iffalse(?![A-Za-z]).*?(?:\\fi(?![A-Za-z])|\Z)", re.S)
_ARGS = r"(?:\[[^\]]*\])?(?:\{[^{}]*\})?"
_MARK = re.compile(
    r"\\(?:(?P<accent>[\^'\"`~=.]|[cvuHkr](?=[\s{]))\s*(?:\{\s*\\?([A-Za-z])\s*\}|\\?([A-Za-z]))"
    rf"|(?P<hidden>(?:label|(?:eq|page|auto|c)?ref|[cC]ite[a-z]*|nocite|input|include|subfile|includegraphics|bibliography(?:style)?|usepackage|documentclass|bibitem|index|vspace|hspace|pagestyle|setcounter|bibliographystyle|addbibresource)\*?(?![A-Za-z])\s*{_ARGS}{_ARGS})"
    r"|(?P<env>(?:begin|end)\s*\{([^{}]*)\}(?:\[[^\]]*\])?(?P<spec>\{(?:[^{}]|\{[^{}]*\})*\})?)"
    rf"|(?P<letter>(?:{'|'.join(sorted(LETTERS, key=len, reverse=True))})(?![A-Za-z])[ \t]*)"
    r"|(?P<word>[A-Za-z@]+)\*?"
    r"|(?P<glue>-|/)"
    r"|(?P<other>.|\n))",
    re.S,
)
WORD = re.compile(r"[^\W_]+")


def macros(text: str) -> dict[str, str]:
    """The author's own commands without arguments, by name."""
    if "\\newcommand" not in text and "\\def" not in text and "\\renewcommand" not in text:
        return {}
    return {a or b: body.replace("\\xspace", " ") for a, b, body in _DEFINITION.findall(text) if "#" not in body}


def without_definitions(text: str) -> str:
    """What a reader sees has no definitions in it."""
    return _DEFINITION.sub(" ", text)


def plain(text: str, own: dict[str, str]) -> str:
    """Markup resolved: accents, own commands, soft hyphens; commands without visible text dropped, arguments of the others
    kept, math left as its signs. Comments must be dealt with before."""

    def put(m: re.Match) -> str:
        kind = m.lastgroup
        if (a := m["accent"]) is not None:
            return unicodedata.normalize("NFC", (m[2] or m[3]) + ACCENTS[a])
        if (w := m["letter"]) is not None and w.rstrip() not in own:
            return LETTERS[w.rstrip()]
        if (w := m["word"] or (w and w.rstrip())) is not None:
            if w in own:
                return put_all(own[w], depth + 1) + (" " if m.end() < len(m.string) and m.string[m.end()] in " \n" else "")
            return (" " if w in ("quad", "qquad", "par", "newline", "linebreak", "item", "and", "hline", "space", "thinspace", "enspace") else "")
        if m["glue"] is not None:
            return ""
        if m["env"] is not None:
            return " "
        if m["hidden"] is not None or kind == "hidden":
            return " "
        o = m["other"]
        return o if o in "%&#_$" else ("" if o in "()[]" else " ")

    def put_all(t: str, d: int) -> str:
        nonlocal depth
        before, depth = depth, d
        out = _MARK.sub(put, t) if d < 4 else t
        depth = before
        return out

    depth = 0
    out = put_all(text, 0)
    return out.replace("{", "").replace("}", "").replace("$", "").replace("~", " ").replace("\u00ad", "")


def words(text: str) -> list[str]:
    """Runs of letters and digits, case ignored, in compatibility form."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return WORD.findall(text.lower())


def is_markup(text: str) -> bool:
    """Whether the text is source; in text that lost its commands, a percent sign after a number is just that."""
    return _COMMANDS.search(text) is not None


def visible(text: str) -> str:
    """The source without comments and disabled blocks; a comment takes its line end and the blanks after it along, as in TeX."""
    if "\\iffalse" in text:
        text = _SKIPPED.sub(" ", text)
    if "%" not in text:
        return text
    return _COMMENT.sub(r"\1", text) if is_markup(text) else _NO_SHARE.sub("", text)


def hidden(text: str) -> str:
    """What is commented out or disabled, in order; comment signs dropped, comments of neighbouring lines joined. Pieces that
    aren't neighbours are kept apart by a sign that is no word and that nothing else has."""
    out: list[str] = []
    if "\\iffalse" in text:
        out += [_ANY_COMMENT.sub(r"\1 ", m) for m in _SKIPPED.findall(text)]
    last = -2
    source = is_markup(text)
    for n, line in enumerate(text.split("\n")):
        at = line.find("%")
        while at > 0 and (line[at - 1] == "\\" or not source and line[:at].rstrip(" ")[-1:].isdigit()):
            at = line.find("%", at + 1)
        if at >= 0:
            body = line[at:].lstrip("%")
            if body.strip():
                out.append(body if last == n - 1 else f" {GAP} {body}")
                last = n
    return "\n".join(out)


def everything(text: str) -> str:
    """The source with comment signs dropped and comments and disabled blocks kept in their places."""
    return _ANY_COMMENT.sub(r"\1 ", text)


GAP = "zzgapzz"
_ANY_COMMENT = re.compile(r"(?<!\\)((?:\\\\)*)%+")
