"""Formulas as text, and those inside of texts."""

import time

import pytest

from tessella.operators import formulas as L

N = L.NARROW


def tex(text):
    """Slashes are easier to read than doubled backslashes; `%` stands for a slash."""
    return text.replace("/", "\\").replace("%", "/")


CASES = [
    ("n_1/sin/theta_1=n_2/sin/theta_2", "n₁ sin θ₁ = n₂ sin θ₂"),
    ("6/,/mathrm{CO_2}+/text{Licht und mehr}/rightarrow/mathrm{C_6H_{12}O_6}", f"6{N}CO₂ + Licht und mehr → C₆H₁₂O₆"),
    ("I=I_1+2/sqrt{I_1I_2}/cos/delta", "I = I₁ + 2√(I₁I₂) cos δ"),
    ("/nabla^2u-(1%v^2)/partial^2u%/partial t^2=0", "∇²u − (1/v²)∂²u/∂t² = 0"),
    ("I_0/cos^2/theta", "I₀ cos² θ"),
    ("1{,}22/lambda%D", "1,22λ/D"),
    ("3,5+f(x,y)", "3,5 + f(x, y)"),
    ("299/,792/ /mathrm{m/,s^{-1}}", f"299{N}792 m{N}s⁻¹"),
    ("E_{kin}=/frac{1}{2}mv^2", "Eₖᵢₙ = ½mv²"),
    ("x=/frac{-b/pm/sqrt{b^2-4ac}}{2a}", "x = (−b ± √(b² − 4ac))/(2a)"),
    ("T_{eff}/approx 5800", "T_eff ≈ 5800"),
    ("/vec{F}=m/cdot/vec{a}", "F⃗ = m · a⃗"),
    ("e^{i/omega t}", "e^(iωt)"),
    ("{/displaystyle R={/frac {U}{I}}=/mathrm {const.} }", "R = U/I = const."),
    ("{/displaystyle D=/mathbb {R} /setminus /{3/}}", "D = ℝ ∖ {3}"),
    ("k=/left/{X/in E~/vert ~{/overline {MX}}=r/right/}.", "k = {X ∈ E | M\u0305X\u0305 = r}."),
    ("/begin{aligned}a&={/sqrt {c^{2}-b^{2}}}//b&={/sqrt {c^{2}-a^{2}}}/end{aligned}", "a = √(c² − b²); b = √(c² − a²)"),
    ("f(t)={/begin{pmatrix}r/cos t//r/sin t/end{pmatrix}}", "f(t) = (r cos t; r sin t)"),
    ("|x|={/begin{cases}x,&x/geq 0//[2pt]-x,&x<0/end{cases}}", "|x| = {x, x ≥ 0; −x, x < 0}"),
    ("/begin{matrix}a_{11}x_{1}&+&/cdots &=&b_{1}///vdots &&&&/vdots /end{matrix}", "a₁₁x₁ + ⋯ = b₁; ⋮ ⋮"),
    ("/begin{pmatrix}/begin{array}{cc}a&b/end{array}&c//{d&e}&f/end{pmatrix}", "(a b, c; d&e, f)"),
    ("{1 /over T}/quad", "1/T"),
    ("{n /choose k}=/tbinom nk", "(n über k) = (n über k)"),
    ("/ce {2H2 + O2 -> 2H2O}", "2H₂ + O₂ → 2H₂O"),
    ("/ce{SO4^{2-} + Fe^3+ <=> Al2(SO4)3}", "SO₄²⁻ + Fe³+ ⇌ Al₂(SO₄)₃"),
    ("A / /xrightarrow[unten]{Licht} / B", "A → (Licht) B"),
    ("{/bar {v}}=10{,}6/cdot 10^{6}", "v\u0304 = 10,6 · 10⁶"),
    ("/operatorname {sgn}(p)+/operatorname {arccot} x", "sgn(p) + arccot x"),
    ("{/color {red}7}+1", "7 + 1"),
    ("/sqrt[{n}]{x}+/sqrt[3]{ab}+/sqrt[x]{2}", "ⁿ√x + ∛(ab) + ^(x)√2"),
    ("90^{/circ }+f''^{/prime/prime}", "90° + f''′′"),
    ("/sum _{i=1}^{n}i", "∑_(i = 1)ⁿi"),
    ("x_{2}=5/ .", "x₂ = 5."),
    ("6/arctan {/tfrac {1}{/sqrt {3}}}+{/frac {12}{5}}", "6 arctan 1/√3 + 12/5"),
    ("a/not=b/not/in C", "a ≠ b ∉ C"),
    ("/overrightarrow {AB}/ominus /imath", "AB\u20d7 ⊖ ı"),
    ("a/equiv b/pmod{m}", "a ≡ b(mod m)"),
    ("-x+(-y)=-z", "−x + (−y) = −z"),
    ("/Lambda/varsigma/Omega/epsilon/mu", "ΛςΩεμ"),
]


@pytest.mark.parametrize(("latex", "text"), CASES)
def test_formula(latex, text):
    assert L.plain_latex(tex(latex)) == text


def test_percent_and_hats():
    assert L.plain_latex("0{,}29\\ \\mathrel {\\widehat {=}} \\ 29\\ \\%") == "0,29 ≙ 29 %"


@pytest.mark.parametrize("latex", ["/underbrace {1-1} _{x}", "/begin{tabular}{cc}a&b/end{tabular}", "/mathbb {K}", "", None, "x" * 1001, "x^{" * 333, "{" * 1000, "^{" * 300, "/foo", "/not x", "{}"])
def test_no_text_form(latex):
    assert L.plain_latex(latex and tex(latex)) is None


def test_every_command_of_the_tables_is_read_and_no_other():
    for name in [*L.GREEK, *L.RELATIONS, *L.OPERATORS, *L.SYMBOLS]:
        assert L.plain_latex((f"\\{name}" if name.isalpha() or name in L.SYMBOLS else name) + " x")
    for name in ["alphabet", "sinx", "fraction", "beginning", "leftover"]:
        assert L.plain_latex(f"\\{name} x") is None and L.plain_latex(f"\\{name} x", strict=False) == f"{name}x"


def test_scripts_come_from_the_names_of_unicode():
    assert "".join(sorted(c for c in L.LOWERED if c.isascii())) == "()+0123456789=aehijklmnoprstuvx" and "".join(sorted(L.RAISED)) == "()+0123456789=in−"
    assert L.FRACTIONS[("3", "4")] == "¾" and L.DOUBLE["Z"] == "ℤ"


def test_formulas_in_texts(spark):
    texts = [
        (1, tex("Gesetz /(n_1/sin/theta/), wobei /[E=mc^2/]."), "Gesetz n₁ sin θ, wobei E = mc²."),
        (2, "Ein Euro kostet 5 $ [2].", "Ein Euro kostet 5 $ [2]."),
        (3, tex("/[ababbcbc/] und /[3/]"), tex("/[ababbcbc/] und /[3/]")),
        (4, tex("Es gilt /(n_1 ohne Ende."), tex("Es gilt /(n_1 ohne Ende.")),
        (5, tex("/(/foo{x}+1/)"), "foox + 1"),
        (6, None, None), (7, "", ""),
        (8, tex("/(") * 20_000 + "x", tex("/(") * 20_000 + "x"),
        (9, tex("/(" + "x+" * 260 + "1/)"), tex("/(" + "x+" * 260 + "1/)")),
    ]
    began = time.perf_counter()
    rows = L.in_texts(spark.createDataFrame([t[:2] for t in texts], "id int, text string"), "id").collect()
    assert {r.id: r.text for r in rows} == {i: want for i, _, want in texts}
    assert time.perf_counter() - began < 60
    assert L.in_texts(spark.createDataFrame([], "id int, text string"), "id").count() == 0
