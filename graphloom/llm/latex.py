"""Words and running prose of articles in typesetting markup. Plain functions on one text, called from Arrow batches."""

from __future__ import annotations

import re
import unicodedata

#: Where a macro definition starts, up to the name: \newcommand{\x} and \newcommand\x, or \def\x with its parameter text.
_DEFINITION = re.compile(
    r"\\(?:(?:re|provide)?newcommand|(?:re|provide)command|DeclareMathOperator|DeclareRobustCommand)\*?\s*+(?:\{\s*+\\([A-Za-z]+)\s*+\}|\\([A-Za-z]+))\s*+(?:\[(\d)\]\s*+)?"
    r"|\\[egx]?def\s*+\\([A-Za-z]+)((?:#\d)*+)\s*+(?=\{)"
)
#: Commands whose braced argument is a key, a file or a layout and not text.
KEYED = (
    "cite", "citep", "citet", "citeauthor", "citeyear", "citealp", "citealt", "nocite", "ref", "eqref", "pageref", "autoref", "cref", "Cref", "label",
    "bibitem", "input", "include", "subfile", "bibliography", "bibliographystyle", "usepackage", "RequirePackage", "documentclass", "documentstyle",
    "includegraphics", "pagestyle", "thispagestyle", "begin", "end", "vspace", "hspace", "setcounter", "setlength", "newcounter", "graphicspath", "hypersetup", "url",
)
#: Environments that are formulas, tables, figures, bibliography or drafts, and not running prose.
NOT_PROSE = (
    "equation", "align", "eqnarray", "gather", "multline", "displaymath", "math", "array", "pmatrix", "bmatrix", "matrix", "cases", "split",
    "tabular", "tabularx", "longtable", "table", "figure", "wrapfigure", "tikzpicture", "thebibliography", "comment", "verbatim", "lstlisting", "algorithm",
)
_KEYED = re.compile(r"\\(?:begin\s*+\{(?:tabular[x*]?|array|longtable|thebibliography)\}(?:\[[^\]]*+\])?(?:\{[^{}]*+\})?|(?:" + "|".join(KEYED) + r")\*?(?![A-Za-z])\s*+(?:\[[^\]]*+\]\s*+)*+\{[^{}]*+\})")
_COMMAND = re.compile(r"\\(?:[A-Za-z]+\*?|[\s\S])")
_WORD = re.compile(r"[^\W_]+")
_COMMENT = re.compile(r"(?<!\\)((?:\\\\)*)%[^\n]*")
_DROPPED = re.compile(r"\\iffalse\b[\s\S]*?(?:\\fi\b|\Z)|\\begin\{(" + "|".join(NOT_PROSE) + r")(\*?)\}[\s\S]*?(?:\\end\{\1\2\}|\Z)")
_FORMULA = re.compile(r"\$\$[\s\S]*?\$\$|(?<!\\)\$[^$]*\$|\\\[[\s\S]*?\\\]|\\\([\s\S]*?\\\)")
_NOT_RUNNING = re.compile(r"\\(?:todo|title|author|thanks|date|affiliation|address|email|keywords|(?:sub)*section|chapter|part|paragraph|caption|footnotetext)\*?(?![A-Za-z])\s*+(?:\[[^\]]*+\]\s*+)?(?=\{)")
_BRACE = re.compile(r"\\[\s\S]|[{}]")
_BLANK = re.compile(r"\s*+")
_PARAMETER = re.compile(r"#(\d)")
#: An expanded text holds at most this many times the characters of the document's text and macros: nested doublings end there.
MOST_GROWTH = 64

Macro = tuple[int, "str | None", str]  # number of arguments, default of the first, body


def group(text: str, at: int) -> int:
    """Behind the group whose brace opens at `at`, counting braces at any depth; -1 if it does not close."""
    depth = 0
    for m in _BRACE.finditer(text, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return m.end()
    return -1


def _bracket(text: str, at: int) -> int:
    """Behind the bracket that opens at `at`; brackets in braces do not count; -1 if it does not close."""
    depth = 0
    for m in re.compile(r"\\[\s\S]|[{}\]]").finditer(text, at):
        if m[0] == "]" and not depth:
            return m.end()
        depth += (m[0] == "{") - (m[0] == "}")
    return -1


def _defined(text: str) -> tuple[str, dict[str, Macro]]:
    """The text with blanks in place of its macro definitions, and the macros by name; of several definitions the last holds."""
    if "\\" not in text or ("command" not in text and "def" not in text and "Declare" not in text):
        return text, {}
    macros: dict[str, Macro] = {}
    out, done, unclosed = [], 0, False
    at = 0
    while not unclosed and (m := _DEFINITION.search(text, at)):
        at, start, default = m.end(), m.end(), None
        if not m[4] and text.startswith("[", start):
            end = _bracket(text, start)
            if end < 0:
                continue
            default, start = text[start + 1 : end - 1], _BLANK.match(text, end).end()
        if not text.startswith("{", start):
            continue
        end = group(text, start)
        if end < 0:
            unclosed = _BRACE.search(text, start) is None  # later groups may still close
            continue
        arguments = len(m[5]) // 2 if m[4] else int(m[3] or 0)
        macros[m[1] or m[2] or m[4]] = (arguments, default, text[start + 1 : end - 1])
        out += [text[done : m.start()], " " * (end - m.start())]
        at = done = end
    return "".join([*out, text[done:]]) if macros else text, macros


def _recursive(macros: dict[str, Macro], use: re.Pattern) -> frozenset[str]:
    """The macros whose expansion leads back to themselves."""
    direct = {n: {m[1] for m in use.finditer(b)} for n, (_, _, b) in macros.items()}
    out = set()
    for n in macros:
        seen, todo = set(), list(direct[n])
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += direct[x]
        if n in seen:
            out.add(n)
    return frozenset(out)


def _expanded(text: str, macros: dict[str, Macro]) -> str:
    """Each use of a macro replaced by its definition; see `_pieces`."""
    return "".join(piece for piece, _, _ in _pieces(text, macros))


def _pieces(text: str, macros: dict[str, Macro]) -> list[tuple[str, int, int]]:
    """The text with each use of a macro replaced by its definition, to any depth of macros in macros, as (piece, start, end):
    a piece that stands in the text itself from `start` on (end is -1), or that a use from `start` to `end` gave.

    A macro that leads back to itself stays as it is inside its own expansion, so such definitions end. A use with fewer braced
    arguments than the macro takes stays too. The result is at most MOST_GROWTH times as long as the text and the macros'
    bodies; what is left to expand then stays as written.
    """
    use = re.compile(r"\\(" + "|".join(sorted(map(re.escape, macros), key=len, reverse=True)) + r")(?![A-Za-z])")
    room = MOST_GROWTH * (len(text) + sum(len(b) for _, _, b in macros.values())) + 10_000
    recursive = _recursive(macros, use)
    out: list[tuple[str, int, int]] = []
    # Text, place in it, the recursive macros it comes from, and where the use that gave it stands (nowhere for the text itself).
    todo: list[tuple[str, int, frozenset, tuple[int, int] | None]] = [(text, 0, frozenset(), None)]
    while todo:
        text, at, above, origin = todo.pop()
        put = lambda a, b, text=text, origin=origin: out.append((text[a:b], *(origin or (a, -1))))
        m = use.search(text, at)
        while m and (m[1] in above or room <= 0):
            m = use.search(text, m.end())
        if not m:
            put(at, len(text))
            continue
        count, default, body = macros[m[1]]
        end, given = m.end(), []
        if default is not None:
            given.append(default)
            start = _BLANK.match(text, end).end()
            if text.startswith("[", start) and (close := _bracket(text, start)) > 0:
                given[0], end = text[start + 1 : close - 1], close
        while len(given) < count:
            start = _BLANK.match(text, end).end()
            close = group(text, start) if text.startswith("{", start) else -1
            if close < 0:
                break
            given.append(text[start + 1 : close - 1])
            end = close
        if len(given) < count:
            put(at, m.end())
            todo.append((text, m.end(), above, origin))
            continue
        if not count and text.startswith("{}", end):
            end += 2
        put(at, m.start())
        full = _PARAMETER.sub(lambda a: given[int(a[1]) - 1] if 0 < int(a[1]) <= len(given) else " ", body) if count else body
        room -= len(full)
        todo.append((text, end, above, origin))
        todo.append((full, 0, above | {m[1]} if m[1] in recursive else above, origin or (m.start(), end)))
    return out


def words(text: str) -> list[str]:
    """All words of a document in order, in lower case: runs of letters or digits outside commands and their keys.

    Commented text counts; comment signs, line ends, punctuation and commands do not interrupt. A macro that the document
    defines reads as its definition.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "\\" in text:
        text, macros = _defined(text)
        text = _KEYED.sub(" ", text)
        if macros:
            text = _KEYED.sub(" ", _expanded(text, macros))
        text = _COMMAND.sub(" ", text)
    return _WORD.findall(text.lower())


def _blanked(m: re.Match) -> str:
    return " " * len(m[0])


def located(text: str) -> tuple[str, list[str], list[int], list[int]]:
    """(text, words, starts, ends): the text in its composed form, its words as `words` gives them, and from where to where
    each stands in it; a word of a macro's expansion stands where the macro is used."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    pieces, macros = [(text, 0, -1)], {}
    if "\\" in text:
        plain, macros = _defined(text)
        plain = _KEYED.sub(_blanked, plain)
        pieces = _pieces(plain, macros) if macros else [(plain, 0, -1)]
    whole = "".join(p for p, _, _ in pieces)
    if "\\" in whole:
        whole = _COMMAND.sub(_blanked, _KEYED.sub(_blanked, whole) if macros else whole)
    found, starts, ends = [], [], []
    n, begin, behind = 0, 0, len(pieces[0][0])  # the piece that a word begins in
    for m in _WORD.finditer(whole):
        while m.start() >= behind:
            n, begin = n + 1, behind
            behind += len(pieces[n][0])
        _, at, end = pieces[n]
        start = at + m.start() - begin if end < 0 else at
        # A word may run on over pieces, as where a macro ends it.
        k, first, last = n, begin, behind
        while m.end() > last:
            k, first = k + 1, last
            last += len(pieces[k][0])
        _, at, end = pieces[k]
        stop = at + m.end() - first if end < 0 else end
        for w in _WORD.findall(m[0].lower()):
            found.append(w)
            starts.append(start)
            ends.append(stop)
    return text, found, starts, ends


def without_words(text: str, ranges: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(text without the words whose places lie in any range, how many these are, how many words there were)."""
    text, found, starts, ends = located(text)
    out, done, removed, upto = [], 0, 0, -1
    for first, last in sorted(ranges):
        for n in range(max(first, upto + 1), min(last, len(found) - 1) + 1):
            removed += 1
            if starts[n] >= done:
                out.append(text[done : starts[n]])
            done = max(done, ends[n])
        upto = max(upto, last)
    return "".join([*out, text[done:]]), removed, len(found)


def _without(text: str, command: re.Pattern) -> str:
    """The text without the commands and the group that follows each; a group that does not close stays."""
    out, done, at = [], 0, 0
    while m := command.search(text, at):
        at = group(text, m.end())
        if at < 0:
            break
        out.append(text[done : m.start()])
        done = at
    return " ".join([*out, text[done:]]) if out else text


def prose(text: str) -> str:
    """An article's running prose, in lower case: no preamble, comments, drafts, formulas, tables, figures, headings or
    bibliography, and no commands."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "%" in text:
        text = _COMMENT.sub(r"\1", text)
    if "\\" in text or "$" in text:
        text, macros = _defined(text)
        start = text.find("\\begin{document}")
        if start >= 0:
            text = text[start + 16 :]
        end = text.find("\\end{document}")
        if end >= 0:
            text = text[:end]
        text = _DROPPED.sub(" ", text)
        text = _FORMULA.sub(" ", text)
        text = _without(text, _NOT_RUNNING)
        text = _KEYED.sub(" ", text)
        if macros:
            text = _FORMULA.sub(" ", _KEYED.sub(" ", _expanded(text, macros)))
        text = _COMMAND.sub(" ", text)
    return text.lower()


def prose_words(text: str) -> list[str]:
    """The words of an article's running prose, in order."""
    return _WORD.findall(prose(text))
