"""Planted secrets in every form that names a literal, and prose, getters and placeholders that are none."""

import random
import string
import time

import pytest

from galvane.llm.secrets import SENSITIVE, SENSITIVE_PAIRS, THRESHOLD, redacted, scan

FORMS = [
    'db_{name} = "{x}"', "const {name} = `{x}`;", "{name}: '{x}'", "config.set_{name}('{x}')", 'builder.{name}("{x}")', 'props.put("db.{name}", "{x}")',
    "<{name}>{x}</{name}>", "export DB_{name}=${{KEY}}\nKEY2={x}", 'k = "{x}"\nconn.{name} = k', 'a = "{x}" + "tail"\n{name} := a', '{name} => "{x}"',
]
BEARER = ["Authorization: Bearer {x}", '{{"Authorization": "Bearer {x}"}}', "-H 'authorization: Basic {x}'"]
NAMES = ["password", "pwd", "secret", "apiKey", "access_key", "private_key", "client_secret", "passphrase", "salt", "signature", "authToken"]
FORMS.pop(7)  # a variable that nothing in the text defines


def value(rng):
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(28, 40)))


def test_planted_are_found():
    rng, missed, n = random.Random(3), [], 0
    for _ in range(5):
        for form in [f.replace("{name}", name) for f in FORMS for name in NAMES] + BEARER:
            x = value(rng)
            text = "some words before\n" + form.format(x=x) + "\nand after, é"
            n += 1
            if x in redacted(text) or not any(a <= text.index(x) and text.index(x) + len(x) <= b for _, a, b in scan(text)[1]):
                missed.append(text)
    assert n > 500 and len(missed) <= 0.02 * n, missed[:5]


@pytest.mark.parametrize("text", [
    'The password: "please enter your new one here"', 'getPassword("prod/database/main/Key9")', 'print("aB3dE5gH7jK9mN1pQ3sT5vW7yZ9")', 'password = "changeme"', 'setTitle("aB3dE5gH7jK9mN1pQ3sT5vW7yZ9")',
    "<title>aB3dE5gH7jK9mN1pQ3sT5vW7yZ9</title>", 'passphrase = "two words"', "Authorization is needed: bearer bonds fell", 'setPassword("${DB_PASSWORD}")', "the secret (it was said) lies open",
])
def test_clean_stays(text):
    assert [x for x in scan(text)[1] if x[0] == "lex"] == []


def test_phrases_and_weights():
    text = 'passphrase = "correct horse battery staple"'
    assert redacted(text) == 'passphrase = "[SECRET]"'
    assert min([*SENSITIVE.values(), *SENSITIVE_PAIRS.values()]) > THRESHOLD - 1


@pytest.mark.parametrize("unit", ['f("', "<a>", "<a", "a.b(", 'setPassword("x", ', "Authorization: Bearer ", "`", "x" * 7, "Authorization   "])
def test_time_is_linear(unit):
    took = []
    for n in (20_000, 80_000):
        t = time.perf_counter()
        scan(unit * n)
        took.append(time.perf_counter() - t)
    assert took[1] < 10 * took[0] + 0.5
