"""Cosines and inheritance against plain Python."""

import math
import re
from collections import Counter

from evgraph.llm import licenses

FILES = [
    ("a/LICENSE", "Some words.\nLicensed under the Apache License, Version 2.0.\nmore"),
    ("a/x/f.txt", "nothing here"), ("a/x/g.txt", "Released under the MIT License.\n Licensed under CC BY-NC 4.0."),
    ("a/x/LICENSE-2", "This work is licensed under the GNU General Public License, version 3."),
    ("a/x/y/z/deep", None), ("ab/f", ""), ("top", "released under the mit license"), ("b/LICENSE.md", "no licence at all is granted for this"),
    ("b/f", "the license of the license " * 50), ("a/x/g.txt", "Released under the MIT License.\n Licensed under CC BY-NC 4.0."),
    (None, "Released under the MIT License."), ("c/e", "x" * 20_000 + "\nReleased under the MIT  License!\n"),
]


def tokens(text):
    return re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower())


def plain(files, least):
    n = len(files)
    vocabulary = {w for _, t in licenses.TEMPLATES for w in tokens(t)}
    df = Counter(w for _, t in files for w in set(tokens(t or "")) & vocabulary)
    idf = lambda w: math.log((1 + n) / (1 + (df[w] if w in vocabulary else 0))) + 1
    vector = lambda t: {w: k * idf(w) for w, k in Counter(tokens(t)).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = {}
    for path, text in files:
        for line in (text or "").split("\n"):
            if re.search(licenses.HINT, line):
                v = vector(line)
                for name, t in licenses.TEMPLATES:
                    u = vector(t)
                    cos = round(sum(v[w] * u.get(w, 0) for w in v) / (size(v) * size(u)), 6)
                    if cos >= least and path is not None:
                        own[path] = min(own.get(path, (0, "~")), (-cos, name))
    folder = lambda p: p.rpartition("/")[0]
    declared = {}
    for path, best in own.items():
        if re.match(licenses.LICENCE_FILE, path.rpartition("/")[2]):
            declared[folder(path)] = min(declared.get(folder(path), (0, "~")), best)
    out = []
    for path, _ in files:
        if path in own:
            out.append((path, own[path][1], "own", None))
            continue
        at = folder(path) if path is not None else None
        while at not in declared and at:
            at = folder(at)
        hit = declared.get(at) if path is not None else None
        out.append((path, hit[1], "inherited", at) if hit else (path, None, "none", None))
    return out


def test_equals_plain_scan(spark):
    files = spark.createDataFrame([(p, t, "x") for p, t in FILES], "path string, text string, license string")
    got = sorted(((r.path, r.license, r.source, r.origin) for r in licenses.scan(files).collect()), key=str)
    assert got == sorted(plain(FILES, 0.6), key=str)
    assert {s for _, _, s, _ in got} == {"own", "inherited", "none"}
    assert licenses.scan(files.limit(0)).collect() == []
