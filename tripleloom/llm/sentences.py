"""Articles as running sentences: headings, titles, keywords, captions, formulas, tables and references left out."""

from __future__ import annotations

import re

from tripleloom.llm import tex

_NESTED = r"\s*(?:\[[^\]]*\])?\s*\{(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*\}"
_NO_TEXT = re.compile(
    r"\\(?:title|author|date|thanks|keywords|caption|(?:sub){0,2}section|sect|chapter|paragraph|footnotetext|institute|address|email|affil)\*?(?![A-Za-z])" + _NESTED
    + r"|\\begin\{(equation|align|displaymath|gather|multline|eqnarray|math|tabular|tabularx|array|figure|table|tikzpicture|verbatim|lstlisting)(\*?)\}.*?(?:\\end\{\1\2\}|(?=\n[ \t]*\n)|\Z)"
    + r"|\\begin\{(?:thebibliography|keywords?)\}.*?(?:\\end\{(?:thebibliography|keywords?)\}|\Z)"
    + r"|\\bibitem.*?(?=\n|\Z)"
    + r"|\\end\{document\}.*"
    + r"|\$\$?[^$]*\$\$?|\\\(.*?\\\)|\\\[.*?\\\]",
    re.S,
)
_HEAD = re.compile(r"^[ \t]*(?:(?:\d+(?:\.\d+)*|[A-Z])\s\s+)?[A-ZÀ-Þ][A-ZÀ-Þ \t'’-]{2,}$|^[ \t]*(?:Figure|Table|Fig\.|Abbildung|Tabelle|Tableau|Figura|Tabla)\s+\d+\s*[:.].*(?:\n(?![ \t]*\n).*)*|^[ \t]*(?:Key\s?words|Keywords|Mots[- ]cl[ée]s|Schlagw[öo]rter|Palabras clave)\b.*(?:\n(?![ \t]*\n).*)*|^[ \t]*\[[^\]\n]{1,20}\].*(?:\n(?![ \t]*\n)(?![ \t]*\[).*)*", re.M)
_REFERENCES = re.compile(r"^[ \t]*(?:\d+\s+)?(?:REFERENCES|BIBLIOGRAPHY|References|Bibliography|Literatur|LITERATUR|RÉFÉRENCES|Références|REFERENCIAS|Referencias)[ \t]*$", re.M)
_END = re.compile(r"(?<=[.?!])[\s)\"'»”]+|\n[ \t]*\n")


def body(text: str) -> str:
    """The running text of an article, markup resolved and own commands spelled out."""
    own = tex.macros(text)
    t = tex.visible(text)
    start = t.find("\\begin{document}")
    if start >= 0:
        t = t[start + 16 :]
    if own:
        t = tex.without_definitions(t)
    if "\\" in t:
        t = tex.plain(_NO_TEXT.sub(" ", t), own)
    if (m := _REFERENCES.search(t)) is not None:
        t = t[: m.start()]
    return _HEAD.sub("\n\n", t)


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence; sentences without words are left out."""
    out = [tex.words(s) for s in _END.split(body(text))]
    return [s for s in out if s]
