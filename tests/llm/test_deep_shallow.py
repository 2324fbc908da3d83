import os
import random

from tsflow.llm.deep_shallow import blind_order, deep_shallow


def check(strings):
    order, lcps = deep_shallow(strings)
    assert sorted(order) == list(range(len(strings)))
    got = [strings[i] for i in order]
    assert got == sorted(strings)
    assert lcps[1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(got, got[1:], strict=False)]


def test_random_and_repetitive():
    r = random.Random(4)
    check([])
    check([b""])
    check([b"", b"", b"a", b"a\x00", b"a\x00\x00", b"\xff" * 40, b"\xff" * 39])
    for _ in range(300):
        text = bytes(r.choice(b"ab") for _ in range(r.randint(1, 200))) * r.randint(1, 3)
        check([text[i:i + r.choice((5, 16, 60, 400))] for i in range(len(text))])
    base = bytes(r.randrange(256) for _ in range(500))
    strings = []
    for _ in range(400):
        s = bytearray(base[:r.randint(0, 500)])
        if s and r.random() < .8:
            s[r.randrange(len(s))] = r.randrange(256)
        strings.append(bytes(s))
    check(strings)


def test_blind_order_alone():
    strings = [b"xxab", b"xxa", b"xxb", b"xxab", b"xx", b"xxabc"]
    assert [strings[i] for i in blind_order(strings, list(range(6)), 2)[0]] == sorted(strings)
