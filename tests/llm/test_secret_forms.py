"""Lexed secrets: forms of source, configuration and markup, values in parts, and programs whose values are worked out by hand."""

import random
import time

import pytest

from folioforge.llm import secrets

V = "Zx81kQmm2p99"
FORMS = [
    'key="DbPassword" value="{}"', '<add key="DbPassword" value="{}"/>', "<password>{}</password>", '<entry key="db.password">{}</entry>', '{{"name": "DB_PASSWORD", "value": "{}"}}',
    "password:\n  {}\n", 'password:\n  "{}"\n', "secret: |\n  {}\n", "secret: >-\n  {}\nother: 1", "token:\n  - {}\n  - x", "- name: DB_PASSWORD\n  value: {}", 'env:\n  - name: DB_PASSWORD\n    value: "{}"',
    'String password = new String("{}");', 'pw_credential = os.getenv("PP", "{}")', '{{"credentials": {{"user": "bob", "value": "{}"}}}}', "credentials:\n  user: bob\n  value: {}\n",
    'db_pwd' + " " * 800 + '= "{}"', 'a.b.c.d.e.f.g.h.i.j.k.api_credential = "{}"', "x" * 2000 + '_pwd = "{}"', 'pwd = (\n  "{}"\n)', 'pwd = ["a", "{}"]', 'A += "{}"\npwd = A',
]
PARTS = [
    ('credential = "Zx81kQ" "mm2p99"', ["Zx81kQ", "mm2p99"]), ('BASE = "Zx81"\nTAIL = "kQmm2p99"\npwd = BASE + TAIL', ["Zx81", "kQmm2p99"]), ('A = "Zx81"\nA += "kQmm2p99"\nmy_pwd = A', ["Zx81", "kQmm2p99"]),
    ('pwd = (\n "Zx81"\n "kQmm2p99"\n)', ["Zx81", "kQmm2p99"]), ("pwd: |\n  Zx81\n  kQmm2p99\nx: 1", ["Zx81", "kQmm2p99"]),
]
CLEAN = [
    'token = os.getenv("API_KEY_PROD_2024")', 'pwd = os.environ["API_PWD_KEY_1"]', "The token of love is a secret: nothing else, he said.", 'password_hint = "Zx81kQmm2p99"', '{"token": {"issuer": "Zx81kQmm2p99"}}',
    '<user id="a1">Zx81kQmm2p99</user>', "secret:\n  nothing to see here\n", 'pwd = input("Enter your password now: ")', "name: DB_PASSWORD\nother: Zx81kQmm2p99", 'pwd = "changeme"',
]


def literals(text):
    return sorted(text[a:b] for _, a, b in secrets.lexed_spans(text))


@pytest.mark.parametrize("form", FORMS)
def test_forms(form):
    text = form.format(V)
    assert literals(text) == [V] and V not in secrets.redacted(text)


def test_values_in_parts():
    for text, want in PARTS:
        assert literals(text) == sorted(want) and not any(x in secrets.redacted(text) for x in want), text


def test_clean_texts():
    for text in CLEAN:
        assert literals(text) == [], text


def test_programs_by_hand():
    """Random programs of assignments: every literal of what reaches a sensitive name, if that is secret as a whole, and no other one."""
    r = random.Random(5)
    for _ in range(300):
        plain, hot = ["alpha", "beta", "gamma"], ["db_pwd", "credential", "authKey"]
        known: dict[str, list[str]] = {}
        lines, want = [], set()
        for n in range(r.randrange(1, 12)):
            name = r.choice(plain + hot)
            parts, words = [], []
            for _ in range(r.randrange(1, 4)):
                if known and r.random() < 0.4:
                    other = r.choice(sorted(known))
                    parts.append(other)
                    words += known[other]
                else:
                    word = f"{'Zk' if r.random() < 0.7 else 'a'}{n}{r.randrange(10**r.randrange(1, 8))}q"
                    parts.append(f'"{word}"')
                    words.append(word)
            adds = name in known and r.random() < 0.3
            lines.append(f"{name} {'+=' if adds else '='} {' + '.join(parts)}")
            known[name] = [*known[name], *words] if adds else words
            if name in hot:
                score = secrets.name_score(name)
                value = known[name]
                if score * secrets.literal_score("".join(value)) >= secrets.LEAST:
                    want |= set(value)
                want |= {x for x in value if score * secrets.literal_score(x) >= secrets.LEAST}
        text = "\n".join(lines)
        assert set(literals(text)) == want, text


def test_long_texts_in_linear_time():
    odd = ["secret = a + b\n" + "a = b + b; b = a + a;" * 20_000, 'secret = secret + "x1y2z3"\n' * 20_000, '{"token": ' * 50_000, "secret: \n" + " " * 1000 + "x\n" * 50_000, "<a " * 50_000 + "password:", "token = (" * 50_000, "secret" + " " * 200_000 + "= x", "a-" * 100_000 + "token = 1"]
    for text in odd:
        began = time.time()
        secrets.spans(text)
        assert time.time() - began < 20, text[:40]
