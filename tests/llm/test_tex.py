import pytest

from tripleloom.llm import tex
from tripleloom.llm.sentences import sentences


def read(text):
    return " ".join(tex.words(tex.plain(tex.without_definitions(tex.visible(text)), tex.macros(text))))


@pytest.mark.parametrize(
    "source,words",
    [
        (r"St{\"u}aer and Be\~{n}a, T\^oa \'{e}t\'e \ss x", "stüaer and beña tôa été ßx"),
        (r"\emph{many} \textbf{crates} {\it need} {63}~\(43\) $96$ misla\-id wool\ blankets\quad now", "many crates need 63 43 96 mislaid wool blankets now"),
        ("had % check\nswapped num%\n  bered 34\\% of", "had swapped numbered 34 of"),
        ("a % x\n% whole line\nb", "a b"),
        (r"a \cite[p.~2]{x99} b~\ref{sec:1} \label{q} c \begin{tabular}{lp{8cm}} d & e \\ \end{tabular}", "a b c d e"),
        (r"\newcommand{\foo}{jump height\xspace}\def\bar{sea}\newcommand\baz{\foo} the \foo and \bar{}s \baz", "the jump height and seas jump height"),
        (r"\iffalse hidden \fi seen", "seen"),
        ("no markup 21 %. All stays", "no markup 21 all stays"),
        (r"\section{A} 50\% of \\ x_{12}", "a 50 of x 12"),
        ("ﬁne １２ CAFÉ", "fine 12 café"),
        ("", ""),
    ],
)
def test_reading(source, words):
    assert read(source) == words


def test_hidden_text():
    text = "seen 5\\% % one\n% two\n%% three\nseen\n% four\n\\iffalse five \\fi"
    assert tex.words(tex.plain(tex.hidden(text), {})) == ["five", tex.GAP, "one", "two", "three", tex.GAP, "four"]
    assert tex.hidden("nothing") == ""


def test_deep_and_endless_markup():
    loop = r"\newcommand{\a}{\b}\newcommand{\b}{\a} x \a y"
    assert "x" in read(loop)
    assert read("{" * 5000 + "x" + "}" * 5000) == "x"
    assert len(read("\\emph{w} " * 100_000).split()) == 100_000


def test_sentences_of_an_article():
    text = r"""\documentclass{article}
\newcommand{\x}{gene\xspace}
\title{Title words}\author{A. B\thanks{c}}
\begin{document}\maketitle
\begin{abstract}The \x is \emph{here}. Second one~\cite{a}?\end{abstract}
\keywords{k, l}
\section{Head \textbf{x}}\label{s}
% commented out.
By 34\%. In $n = 3$ cases.
\begin{figure}\caption{Caption {nested} text.}\end{figure}
\begin{equation} E = m \end{equation}
\begin{lemma}
Inside lemma.
\end{lemma}
\iffalse Not this. \fi
\begin{thebibliography}{9}\bibitem{a} Reference.\end{thebibliography}
\end{document}
After."""
    assert [" ".join(s) for s in sentences(text)] == ["the gene is here", "second one", "by 34", "in cases", "inside lemma"]
    assert sentences("1  INTRODUCTION\n\nPlain 21 %. Text cite{x}.\n\nREFERENCES\n\n[1] None.") == [["plain", "21"], ["text", "cite", "x"]]
    assert sentences("\\section{A}\nCut off \\begin{thebibliography}{9} \\bibitem{x} never ends") == [["cut", "off"]]
    assert sentences("") == []
