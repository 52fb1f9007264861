import time

from graphloom.llm import latex


def w(text):
    return " ".join(latex.words(text))


def test_markup_does_not_interrupt():
    assert w("The \\emph{big}~cat,\n% sat \\cite[p.~3]{key12} {\\em on}\n\\textbf{the} mat\\label{sec:x}.") == "the big cat sat on the mat"
    assert w("see \\ref{fig:a}\\begin{tabular}{lrr} a & b \\\\ \\end{tabular}") == "see a b"


def test_macros_read_as_their_definition():
    text = "\\newcommand{\\cat}{black  cat}\\def\\dog{big \\cat}\\newcommand{\\two}[2]{#2 and #1}\\DeclareMathOperator{\\op}{oper}\nA \\cat{} and \\dog, \\two{x}{y} \\op z \\catalog"
    assert w(text) == "a black cat and big black cat y and x oper z"


def test_macros_nest_to_any_depth():
    chain = "".join(f"\\newcommand{{\\m{'abcdefghijkl'[i]}}}{{w{i} {'' if i == 11 else chr(92) + 'm' + 'abcdefghijkl'[i + 1]}}}" for i in range(12))
    assert w(chain + "go \\ma{} stop") == "go " + " ".join(f"w{i}" for i in range(12)) + " stop"
    assert w("\\newcommand{\\zz}{one {{{{{{two}}}}}}} go \\zz stop") == "go one two stop"
    assert w("\\newcommand{\\o}[2][dear]{#1 #2} \\o{x} \\o[big]{y} \\o [b{]}c]{z}") == "dear x big y b c z"
    assert w("\\newcommand{\\a}{\\b x}\\newcommand{\\b}{y \\a} \\a") == "y x"
    assert w("\\newcommand{\\k}{see \\cite{key1} there} \\k") == "see there"
    assert w("\\newcommand{\\n}[1]{in #1 out}\\n{\\n{deep}}") == "in in deep out out"


def test_doubling_macros_end():
    text = "".join(f"\\newcommand{{\\d{'abcdefghijklmnopqrstuvwxyz'[i]}}}{{\\d{'abcdefghijklmnopqrstuvwxyz'[i + 1]} \\d{'abcdefghijklmnopqrstuvwxyz'[i + 1]}}}" for i in range(25)) + "\\newcommand{\\dz}{q}\\da"
    began = time.time()
    assert set(latex.words(text)) <= {"q"} and time.time() - began < 10


def test_self_reference_unbalanced_and_long():
    assert w("\\newcommand{\\a}{x \\a}\\a y").endswith("y")
    assert "b" in latex.words("\\newcommand{\\a}{ {{ open \n b")
    began = time.time()
    assert len(latex.words("word " * 300_000)) == 300_000
    latex.prose_words("{" * 100_000 + "\\begin{equation}" + "$" * 20_001 + "%" * 1000)
    assert time.time() - began < 20


def test_prose_only():
    text = "\\documentclass{a}\\title{T}\n\\begin{document}\\section{Head}\nRun $x+y$ on. % draft\n\\iffalse hidden \\fi\\begin{align}q\\end{align}\\begin{figure}\\caption{c}\\end{figure}\n\\begin{comment}no\\end{comment}50\\% sure\\begin{thebibliography}{9}\\bibitem{k} B\\end{thebibliography}\\end{document} after"
    assert " ".join(latex.prose_words(text)) == "run on 50 sure"
    assert latex.prose_words("") == [] and latex.words("") == []
