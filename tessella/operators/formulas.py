"""LaTeX formulas as text in Unicode.

Formulas repeat (symbols, units, the same law in many articles), so the distinct ones are read once, in Arrow batches, and
come back to their texts by a join. A formula is cut into tokens and read by a grammar of groups, scripts, commands with
arguments, and environments of rows and cells; each gives atoms, and what an atom is (a relation, a binary operator, a
function) sets the blanks around it. A formula with a command that has no text form, one that is too long or nested too
deep, and one that comes out empty have none.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NARROW = "\u202f"
#: Signs of a formula of its own and of one inside a text, levels of groups, at most.
LONGEST, LONGEST_INSIDE, DEEPEST = 1_000, 500, 60


def _signs(listed: str) -> dict[str, str]:
    words = listed.split()
    return dict(zip(words[::2], words[1::2], strict=True))


# LaTeX commands and the signs they stand for.
RELATIONS = _signs(
    """= = < < > > approx ≈ neq ≠ ne ≠ leq ≤ le ≤ leqslant ≤ geq ≥ ge ≥ geqslant ≥ equiv ≡ sim ∼ simeq ≃ cong ≅ doteq ≐ triangleq ≜ propto ∝ ll ≪ gg ≫ lesssim ≲ gtrsim ≳
    to → rightarrow → longrightarrow → leftarrow ← gets ← leftrightarrow ↔ Rightarrow ⇒ implies ⇒ Leftarrow ⇐ Leftrightarrow ⇔ iff ⇔ Longrightarrow ⟹ mapsto ↦ uparrow ↑ downarrow ↓
    rightleftharpoons ⇌ leftrightharpoons ⇋ in ∈ notin ∉ ni ∋ subset ⊂ subseteq ⊆ subsetneq ⊊ supset ⊃ supseteq ⊇ supsetneq ⊋ mid | nmid ∤"""
)
OPERATORS = _signs("+ + - − * · pm ± mp ∓ cdot · times × div ÷ ast ∗ setminus ∖ circ ∘ wedge ∧ land ∧ vee ∨ lor ∨ oplus ⊕ ominus ⊖ otimes ⊗ odot ⊙")
SYMBOLS = _signs(
    """infty ∞ partial ∂ nabla ∇ sum ∑ prod ∏ int ∫ iint ∬ iiint ∭ oint ∮ hbar ħ ell ℓ degree ° textdegree ° ldots … dots … dotsc … dotsb … dotsm … dotso … dotsi … cdots ⋯ vdots ⋮ ddots ⋱
    angle ∠ measuredangle ∡ perp ⊥ parallel ∥ cup ∪ cap ∩ bigcup ⋃ bigcap ⋂ bigoplus ⨁ forall ∀ exists ∃ emptyset ∅ varnothing ∅ neg ¬ lnot ¬ top ⊤ bot ⊥ vert | colon : prime ′
    langle ⟨ rangle ⟩ lfloor ⌊ rfloor ⌋ lceil ⌈ rceil ⌉ lbrace { rbrace } euro € star ⋆ bullet • Re ℜ Im ℑ aleph ℵ triangle △ square □ backslash ∖ dagger † ddagger ‡ imath ı jmath ȷ
    % % { { } } $ $ & & # # _ _ | ‖"""
)
FUNCTIONS = frozenset("sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh coth arsinh arcosh artanh log ln lg exp lim max min inf sup det dim ker arg deg gcd mod bmod sgn Pr".split())
SPACES = {",": NARROW, "!": "", **dict.fromkeys([";", ":", " ", ">", "quad", "qquad", "enspace"], " ")}
AS_TYPED = frozenset("text textrm textit textbf textsf texttt textup textnormal mbox emph".split())
STYLED = frozenset("mathrm mathit mathbf mathsf mathcal mathfrak mathtt mathnormal boldsymbol mathord mathop mathopen mathclose".split())
SILENT = frozenset(
    """displaystyle textstyle scriptstyle scriptscriptstyle limits nolimits left right middle rm it bf sf tt cal nonumber notag strut hline allowbreak
    big Big bigg Bigg bigl bigr bigm Bigl Bigr Bigm biggl biggr biggm Biggl Biggr Biggm""".split()
)
DROPPED = frozenset("color phantom hphantom vphantom vspace label cline".split())
ACCENTS = {"bar": "MACRON", "overline": "OVERLINE", "underline": "LOW LINE", "hat": "CIRCUMFLEX ACCENT", "widehat": "CIRCUMFLEX ACCENT", "tilde": "TILDE", "widetilde": "TILDE", "dot": "DOT ABOVE", "ddot": "DIAERESIS", "check": "CARON", "breve": "BREVE", "acute": "ACUTE ACCENT", "grave": "GRAVE ACCENT", "mathring": "RING ABOVE"}
NEGATED = _signs("= ≠ ∈ ∉ ≡ ≢ ⊂ ⊄ ⊆ ⊈ < ≮ > ≯ ≤ ≰ ≥ ≱ ∼ ≁")
ARROWS = _signs("xrightarrow → xleftarrow ← xrightleftharpoons ⇌ xleftrightarrow ↔")
#: Environments: what opens them, stands between cells, and closes them; rows are parted by semicolons.
LINES = dict.fromkeys("aligned align align* alignat alignat* alignedat gathered gather gather* split eqnarray eqnarray* multline array matrix smallmatrix".split(), ("", " ", ""))
ENVIRONMENTS = LINES | {"pmatrix": ("(", ", ", ")"), "bmatrix": ("[", ", ", "]"), "Bmatrix": ("{", ", ", "}"), "vmatrix": ("|", ", ", "|"), "Vmatrix": ("‖", ", ", "‖"), "cases": ("{", " ", "}"), "dcases": ("{", " ", "}"), "rcases": ("", " ", "}")}
LAID_OUT = {"array", "alignat", "alignat*", "alignedat"}

# By rule: Greek letters, raised and lowered signs, fractions and double-struck letters from the names of Unicode.
_SPELLED = {"epsilon": "EPSILON", "lambda": "LAMDA", **{n: n.upper() for n in "alpha beta gamma delta zeta eta theta iota kappa mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()}}
GREEK = {n: unicodedata.lookup(f"GREEK SMALL LETTER {u}") for n, u in _SPELLED.items()} | {n.capitalize(): unicodedata.lookup(f"GREEK CAPITAL LETTER {_SPELLED[n]}") for n in "gamma delta theta lambda xi pi sigma upsilon phi psi omega".split()}
GREEK |= _signs("varepsilon ε vartheta ϑ varphi φ varrho ϱ varsigma ς varpi ϖ varkappa ϰ")
_NAMED = [(unicodedata.name(c, ""), c) for c in map(chr, [0xB2, 0xB3, 0xB9, *range(0x1D62, 0x1D66), *range(0x2070, 0x209D), 0x2C7C])]
_MINUS = {"-": "−", "\u2212": "−"}
RAISED = {_MINUS.get(d, d): c for name, c in _NAMED if name.startswith("SUPERSCRIPT") for d in [unicodedata.normalize("NFKC", c)]}
LOWERED = {_MINUS.get(d, d): c for name, c in _NAMED if "SUBSCRIPT" in name for d in [unicodedata.normalize("NFKC", c)] if d != "ə"}
FRACTIONS = {tuple(unicodedata.normalize("NFKC", c).split("\u2044")): c for c in "½⅓⅔¼¾"}
DOUBLE = {n: unicodedata.lookup(f"DOUBLE-STRUCK CAPITAL {n}") for n in "CHNPQRZ"}

_TOKEN = re.compile(r"\\(?:[A-Za-z]+|.?)|\s+|.", re.S)
_SIMPLE = re.compile(r"\d+(?:,\d+)?|[√∛∜].|.?", re.S)


class Atom(NamedTuple):
    role: str  # word, relation, operator or function
    text: str


class Refused(Exception):
    """The formula has no text form."""


def spaced(atoms: list[Atom]) -> str:
    """Atoms as text: blanks around relations and operators, none behind a sign, functions apart from their neighbours."""
    out, before = "", "start"
    for role, text in atoms:
        if not text:
            continue
        if role == "relation" or role == "operator" and before == "word" and not out.endswith("(") or role == "operator" and before == "function":
            out = f"{out.rstrip(' ')} {text} "
        elif role == "function":
            out += (" " if out and out[-1] not in f" ({NARROW}" else "") + text + " "
        elif before == "function" and text[0] in "([":
            out = out.rstrip(" ") + text
        else:
            out += text
        before = role
    return re.sub(r" ([.,])(?= |$)", r"\1", re.sub(" +", " ", out)).strip()


def _grouped(text: str) -> str:
    return text if _SIMPLE.fullmatch(text) else f"({text})"


def _fraction(above: str, below: str) -> str:
    return FRACTIONS.get((above, below)) or f"{_grouped(above)}/{_grouped(below)}"


def _mapped(text: str, signs: dict[str, str]) -> str | None:
    return "".join(signs[c] for c in text) if all(c in signs for c in text) else None


def _chemical(text: str) -> str:
    """A chemical equation as text: lowered counts behind elements and brackets, raised charges, arrows."""
    out = ""
    for piece in re.findall(r"<=>|<->|->|<-|[_^](?:\{[^{}]*\}|[\d+-])|(?<=[A-Za-z\])])\d+|\s+|.", text, re.S):
        if piece in ("<=>", "<->", "->", "<-"):
            out += f" {dict(zip(('<=>', '<->', '->', '<-'), '⇌↔→←', strict=True))[piece]} "
        elif piece[0] in "_^" and len(piece) > 1:
            inner = piece[1:].strip("{}").replace("-", "−")
            out += _mapped(inner, LOWERED if piece[0] == "_" else RAISED) or inner
        elif piece.isdigit() and len(out) and (out[-1].isalpha() or out[-1] in ")]"):
            out += _mapped(piece, LOWERED) or piece
        else:
            out += piece
    return " ".join(out.split())


class Reader:
    """Reads the tokens of one formula; strict ones are refused at an unknown command, others keep its name."""

    def __init__(self, latex: str, strict: bool) -> None:
        self.tokens, self.at, self.strict, self.depth = _TOKEN.findall(latex), 0, strict, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        token = self.peek()
        self.at += 1
        return token

    def unknown(self, name: str) -> str:
        if self.strict:
            raise Refused(name)
        return name

    def atoms(self, *stops: str) -> list[Atom]:
        """Atoms up to one of the tokens in stops, which is left, or to the end."""
        self.depth += 1
        if self.depth > DEEPEST:
            raise Refused("depth")
        out: list[Atom] = []
        while (token := self.peek()) and token not in stops:
            self.at += 1
            if token in ("\\over", "\\choose"):
                above, below = spaced(out), spaced(self.atoms(*stops))
                out = [Atom("word", _fraction(above, below) if token == "\\over" else f"({above} über {below})")]
            elif token in ("_", "^"):
                out.append(self.script(out.pop() if out else Atom("word", ""), token))
            elif token == ",":
                out.append(Atom("word", "," if self.peek().isdigit() and out and out[-1].text[-1:].isdigit() else ", "))
            elif not token.isspace():
                out += self.atom(token)
        self.depth -= 1
        return out

    def atom(self, token: str) -> list[Atom]:
        if token == "{":
            return [Atom("word", self.rest_of_group())]
        name = token[1:] if token[0] == "\\" else token
        if token[0] == "\\" and name in SPACES:
            return [Atom("word", SPACES[name])]
        if name in RELATIONS and (token[0] == "\\") == (name.isalpha()):
            return [Atom("relation", RELATIONS[name])]
        if name in OPERATORS and (token[0] == "\\") == (name.isalpha()):
            return [Atom("operator", OPERATORS[name])]
        if token[0] != "\\":
            return [Atom("word", " " if token == "~" else token)]
        return self.command(name)

    def rest_of_group(self) -> str:
        text = spaced(self.atoms("}"))
        self.take()
        return text

    def argument(self) -> str:
        """The next group, or the next sign or command with its own arguments, as text."""
        while self.peek().isspace():
            self.at += 1
        token = self.take()
        return spaced(self.atom(token)) if token else ""

    def typed(self) -> str:
        """The next group or sign as it was typed."""
        while self.peek().isspace():
            self.at += 1
        if self.peek() != "{":
            return self.take()
        start, level = self.at + 1, 0
        while token := self.take():
            level += (token == "{") - (token == "}")
            if not level:
                return "".join(self.tokens[start : self.at - 1])
        return "".join(self.tokens[start:])

    def optional(self) -> str:
        if self.peek() != "[" or "]" not in self.tokens[self.at :]:
            return ""
        self.take()
        text = spaced(self.atoms("]"))
        self.take()
        return text

    def script(self, base: Atom, sign: str) -> Atom:
        text = self.argument()
        if sign == "^" and (text in ("∘", "°") or text and not text.strip("′")):
            added = text.replace("∘", "°")
        else:
            added = _mapped(text, LOWERED if sign == "_" else RAISED)
            if added is None:
                added = f"{sign}{text}" if sign == "_" and text.isalnum() else f"{sign}({text})"
        return Atom("function" if base.role == "function" else "word", base.text + added)

    def command(self, name: str) -> list[Atom]:
        if name in GREEK or name in SYMBOLS:
            return [Atom("word", GREEK.get(name) or SYMBOLS[name])]
        if name in FUNCTIONS:
            return [Atom("function", name)]
        if name in SILENT:
            if name in ("left", "right", "middle") and self.peek() == ".":
                self.take()
            return []
        if name in DROPPED:
            self.typed()
            return []
        if name == "not":
            return [self.negated()]
        if name == "mathrel":
            return [Atom("relation", self.argument())]
        if name == "mathbin":
            return [Atom("operator", self.argument())]
        if name == "operatorname":
            return [Atom("function", self.argument())]
        if name in ARROWS:
            self.optional()
            label = self.argument()
            return [Atom("relation", ARROWS[name] + (f" ({label})" if label else ""))]
        if name in ACCENTS:
            text, mark = self.argument(), unicodedata.lookup(f"COMBINING {ACCENTS[name]}")
            return [Atom("relation", "≙")] if text == "=" and name in ("hat", "widehat") else [Atom("word", "".join(c + mark for c in text))]
        return [Atom("word", self.shaped(name))]

    def shaped(self, name: str) -> str:
        """Commands with arguments, as a word."""
        if name in AS_TYPED:
            return self.typed()
        if name in STYLED:
            return self.argument()
        if name in ("frac", "tfrac", "dfrac", "cfrac"):
            above = self.argument()
            return _fraction(above, self.argument())
        if name in ("binom", "tbinom", "dbinom"):
            above = self.argument()
            return f"({above} über {self.argument()})"
        if name == "sqrt":
            index = self.optional()
            sign = {"": "√", "2": "√", "3": "∛", "4": "∜"}.get(index) or (_mapped(index, RAISED) or f"^({index})") + "√"
            return sign + _grouped(self.argument())
        if name in ("vec", "overrightarrow"):
            return self.argument() + unicodedata.lookup("COMBINING RIGHT ARROW ABOVE")
        if name == "mathbb":
            letters = self.argument()
            return _mapped(letters, DOUBLE) or self.unknown(letters)
        if name == "pmod":
            return f"(mod {self.argument()})"
        if name == "ce":
            return _chemical(self.typed())
        if name == "hspace":
            self.typed()
            return " "
        return self.environment() if name == "begin" else self.unknown(name)

    def negated(self) -> Atom:
        text = self.argument()
        return Atom("relation", NEGATED.get(text) or self.unknown(text))

    def environment(self) -> str:
        """Rows of cells up to the end of the environment."""
        name = self.typed()
        if name not in ENVIRONMENTS:
            return self.unknown(name)
        if name in LAID_OUT:
            self.typed()
        opened, between, closed = ENVIRONMENTS[name]
        rows: list[list[str]] = [[]]
        while True:
            if not rows[-1]:
                self.optional()  # the height of a row
            rows[-1].append(spaced(self.atoms("&", "\\\\", "\\end")))
            end = self.take()
            if end == "\\\\":
                rows.append([])
            elif end != "&":
                break
        self.typed()
        return opened + "; ".join(between.join(filter(None, row)).strip() for row in rows if any(row)) + closed


def plain_latex(latex: str | None, strict: bool = True) -> str | None:
    """One formula as text; null where it has no text form."""
    if not latex or len(latex) > LONGEST:
        return None
    try:
        return spaced(Reader(latex, strict).atoms()) or None
    except Refused:
        return None


def read(formulas: DataFrame, latex: str = "latex", strict: bool = True) -> DataFrame:
    """formulas with a column `plain`: each distinct one is read once."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([plain_latex(t, strict) for t in column.to_pylist()], pa.string())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    distinct = formulas.select(latex).where(F.col(latex).isNotNull()).distinct().withColumn("plain", F.arrow_udf(run, "string")(F.col(latex)))
    return formulas.join(distinct, latex, "left")


def pieces(text: Column) -> Column:
    """A text cut before and behind the marks of formulas."""
    return F.split(text, r"(?=\\[(\[])|(?<=\\[)\]])")


def in_texts(texts: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Rows (by, text): the formulas between \\( \\) or \\[ \\] written out; unknown commands keep their names.

    What has no end, is longer than LONGEST_INSIDE, or stands in \\[ \\] without a sign of a formula stays as it is.
    by tells the texts apart.
    """
    rows = texts.select(by, F.posexplode_outer(pieces(F.col(text))).alias("at", "piece"))
    inner = F.substring("piece", F.lit(3), F.length("piece") - 4)
    ended = F.rlike("piece", F.lit(r"(?s)^\\\(.+\\\)$")) | F.rlike("piece", F.lit(r"(?s)^\\\[.*[\\^_=+<>].*\\\]$"))
    rows = read(rows.withColumn("latex", F.when(ended & (F.length("piece") <= LONGEST_INSIDE + 4), inner)), strict=False)
    whole = F.sort_array(F.collect_list(F.struct("at", F.coalesce("plain", "piece").alias("piece"))))
    out = rows.groupBy(by).agg(F.array_join(F.transform(whole, lambda p: p["piece"]), "").alias("_text"), F.max("at").alias("_at"))
    return out.select(by, F.when(F.col("_at").isNotNull(), F.col("_text")).alias(text))
