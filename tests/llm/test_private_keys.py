"""Private key blocks of every kind are masked whole."""

from __future__ import annotations

import json
import random
import string

from pulsegrid.llm import secret_scan
from tests.llm.conftest import words


def body(rng, size, width=64):
    text = "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(size))
    return "\n".join(text[k : k + width] for k in range(0, size, width))


def block(label, inner):
    return f"-----BEGIN {label}-----\n{inner}\n-----END {label}-----"


def test_whole_blocks_are_masked(make_docs):
    rng = random.Random(8)
    plain = block("RSA PRIVATE KEY", body(rng, 1600))
    keys = {
        1: plain,
        2: block("OPENSSH PRIVATE KEY", body(rng, 60_000)),
        3: plain.replace("\n", "\\n"),
        4: plain.replace("\n", "\\r\\n"),
        5: block("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C3D4E5F60718293A4B5C6D7E8F9\n\n" + body(rng, 1600)),
        6: block("PGP PRIVATE KEY BLOCK", "Version: GnuPG v2 - Linux\nComment: a - b\n\n" + body(rng, 3000) + "\n=aB3d"),
        7: block("PRIVATE KEY", "xxxx0000001234567\n" + body(rng, 800)),
        8: block("EC PRIVATE KEY", body(rng, 3_000_000, 3_000_000)),
        9: "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n" + body(rng, 30_000),
        10: json.dumps(json.dumps(plain))[3:-3],
    }
    start, end = words(rng, 12) + " ", " (" + words(rng, 12) + ")"
    rows = [(k, start + key + end, "en") for k, key in keys.items()]
    rows += [(11, start + json.dumps({"private_key": plain + "\n", "client": "abc"}), "en")]
    rows += [(100 + k, words(rng, 30), "en") for k in range(20)]
    shown = {r.doc_id: r.text for r in secret_scan.redact(make_docs(rows)).collect()}
    for k in keys:
        assert shown[k].replace(" ", "") == (start + secret_scan.MASK + end).replace(" ", ""), k
    assert shown[11] == start + json.dumps({"private_key": secret_scan.MASK}).replace(secret_scan.MASK, secret_scan.MASK + "\\n")[:-1] + ', "client": "abc"}'
    assert all(shown[100 + k] == t for k, (_, t, _) in enumerate(rows[-20:]))


def test_short_values_of_names_are_candidates(make_docs):
    (one,) = secret_scan.candidates(make_docs([(1, "password = 'abc12x' of mine", "en")])).collect()
    assert one.candidate == "abc12x"
