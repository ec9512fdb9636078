"""Brute-force helpers."""

import os
import re

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
