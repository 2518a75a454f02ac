"""Secret scan: typed assignments, triple quotes and long constants."""
import random
import time
from collections import Counter

import pytest

from tessera.llm import secrets

VALUE = "Zk9!qPz7#LmX2"


def lex(text):
    return [text[a:b] for k, a, b, _, _ in secrets.findings(text) if k == "lex"]


@pytest.mark.parametrize("text", [
    'password: str = "%s"', 'const apiSecret: string = "%s";', 'let token: &str = "%s";', "const TOKEN: &'static str = \"%s\";",
    'val password: String? = "%s"', 'password: Optional[Dict[str, str]] = "%s"', 'private password?: string | null = "%s"',
    'secret: std::string::String = "%s"', 'let apiKey:String="%s"', 'password: str=r"%s"', 'char password[] = "%s";',
    'password: Final[str] = """%s"""', 'password = """%s"""', "password = '''%s'''", 'password = """\n%s\n"""', 'password: "%s"',
    'a: str = "%s"\npassword: str = a\n'])
def test_typed_and_triple_quoted(text):
    assert lex(text % VALUE) == [VALUE]
    assert VALUE not in secrets.redacted(text % VALUE)


def test_what_is_no_type():
    assert lex("secret: Zm9vYmFyMTIz=") == ["Zm9vYmFyMTIz="]
    assert lex(f'f(password: x, other = "{VALUE}")') == []
    assert lex('password: str = "xxxxxxxxxxxx"') == [] and lex(f'color: str = "{VALUE}"') == []
    assert lex(f'password: a != "{VALUE}"') == []


def test_constants_of_many_literals():
    parts = [f"p{i}q" for i in range(200)]
    text = "a = " + " + ".join(f'"{p}"' for p in parts) + "\npassword = a\n"
    assert lex(text) == parts
    chain = 'a0 = "Zk9"\n' + "".join(f'a{i} = a{i - 1} + a{i - 1} + "k{i}"\n' for i in range(1, 3000)) + "password = a2999\n"
    start = time.monotonic()
    assert len(lex(chain)) == 3000
    assert time.monotonic() - start < 5


def test_summed_strength_is_that_of_the_text():
    rng = random.Random(4)
    for _ in range(3000):
        parts = ["".join(rng.choices(rng.choice(["x", "xX", "*", "ab1", "abcdefgh", "<>", "a b", "."]), k=rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        parts[0] = rng.choice(["", "your-", "Example", "none", "<"]) + parts[0]
        text, quoted = "".join(parts), rng.random() < 0.5
        want = 0.0
        if not (len(text) < 8 or secrets.PLACEHOLDER.match(text) or any(c.isspace() for c in text)):
            want = min(1.0, secrets._bits(Counter(text)) / 40.0) * (0.5 if not quoted and text.isalpha() else 1.0)
        assert secrets.Value.joined([secrets.Value(p, quoted) for p in parts]).strength() == pytest.approx(want)
