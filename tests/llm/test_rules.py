"""URL rules, revisits and licences: brute force and edge cases; SQL oracles of all."""

import pytest
from pyspark.sql import functions as F

from hearth.catalog.oracle import compare, duck
from hearth.catalog.registry import Entry
from hearth.llm import licenses, urls, warc
from hearth.llm.queries import QUERIES, SQL
from tests.conftest import SF_MID, SF_SMALL


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name, sf):
    ok, msg = compare(spark, duck(sf), Entry(name, QUERIES[name], SQL[name], ()), sf)
    assert ok, msg


def plain_host_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.HOST_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = ["http://EXAMPLE.com/en/x", "https://www.example.com/en/", "http://a.www.example.com/en/1?q#f", "http://x.net/es/",
        "http://x.net/ES/", "http://net/fr/1", "http://xnet/fr/1", "http://com", "http://com/", "http://com?x", "//a.com/",
        "", None, "mailto:a@b.com", "ftp://É.COM/é", "http://a.org/en/5?u=http://b.com/", "a://b://c/d", "http:///p", "http://x.net/fr"]


def test_host_rules_equal_plain(spark):
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = urls.filter_urls(df).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path, rule, verdict = plain_host_rule(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_mined_rules_equal_brute_force(spark):
    rows = [(["h:a", "h:net", "p:ad"], "block")] * 30 + [(["h:b", "h:net", "p:ad"], "allow")] * 20 + \
        [(["h:b", "h:org"], "allow")] * 50
    got = {(tuple(r.tokens), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in urls.mine(
        spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.1, 0.6, 2).collect()}
    want = {}
    items = sorted({t for ts, _ in rows for t in ts})
    for pick in [(a,) for a in items] + [(a, b) for a in items for b in items if a < b]:
        have = [v for ts, v in rows if set(pick) <= set(ts)]
        for v in ("allow", "block"):
            n = have.count(v)
            if n >= 10 and n / len(have) >= 0.6:
                want[pick, v] = (round(n / len(have), 9), round(n / len(rows), 9))
    assert got == want
    rules = urls.UrlRules.build(urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.1, 0.6, 2))
    assert rules.decide(["h:a", "p:ad"])[0] == "block" and rules.decide(["h:org"])[0] == "allow"
    assert rules.decide(["h:zzz"]) == rules.decide([]) == (None, None, None)


def test_urls_without_labels(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (None, None), (1, "http://a.org/x")], "page_id long, url string")
    assert [r.verdict for r in urls.filter_urls(df).collect()] == ["allow"] * 3
    assert urls.filter_urls(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.UrlRules.build(spark.createDataFrame([(["a"], "block", 1.0, 1.0)] * 2,
                                                  "tokens array<string>, verdict string, confidence double, support double"), 1)


RECORDS = "record_id long, kind string, url string, ts long, status int, headers map<string,string>, payload string, key string"


def _resolve(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], RECORDS)
    return {r.record_id: r for r in warc.resolve_revisits(df).collect()}


def test_revisits(spark):
    rows = [
        (1, "response", "http://WWW.a.com:80#x", 100, 200, {"ETag": '"1"', "Content-Type": "t", "Date": "d1", "Set-Cookie": "s"}, "one"),
        (2, "response", "http://a.com/", 5000, 404, {"ETag": '"2"'}, "gone"),
        (3, "response", "https://a.com/", 9000, 200, {"ETag": '"3"'}, "two"),
        (4, "response", "https://a.com/", 9000, 200, {"Last-Modified": "m"}, "three"),
        (10, "revisit", "https://a.com/", 8000, 304, {"etag": 'W/"1"', "DATE": "d2", "Content-Type": "no", "Expires": None}, None),
        (11, "revisit", "https://a.com/", 8000, 304, {"etag": '"9"'}, None),
        (12, "revisit", "https://a.com/", 100, 304, {"etag": '"1"'}, None),
        (13, "revisit", "https://a.com/", 400_000, 304, {"Last-Modified": "m", "Vary": "v"}, None),
        (14, "revisit", "https://a.com/", 400_000, 304, None, None),
        (15, "revisit", None, 9, 304, {"etag": "x"}, None), (16, "revisit", "https://a.com/", None, 304, {}, None),
        (17, "revisit", "https://b.com/", 9, 304, {}, None), (18, "request", "https://a.com/", 9, 304, {}, None),
        (5, "response", "https://a.com/", 99_000, 200, {}, None)]
    got = _resolve(spark, rows)
    assert set(got) == {10, 11, 12, 13, 14, 15, 16, 17}
    assert [got[i].outcome for i in range(10, 18)] == ["resolved", "changed", "no_response", "resolved", "no_validator",
                                                       "no_response", "no_response", "no_response"]
    assert got[10].response_id == 1 and got[13].response_id == 4 and got[11].response_id == 1
    assert got[10].headers == {"etag": 'W/"1"', "content-type": "t", "date": "d2", "set-cookie": "s"}
    assert got[13].headers == {"last-modified": "m", "vary": "v"} and got[11].headers is None
    assert got[10].payload_digest and got[11].payload_digest is None
    assert _resolve(spark, []) == {}


def test_as_of_equals_brute_force(spark):
    import random
    random.seed(4)
    rows = [(f"u{random.randint(0, 3)}", random.randint(0, 40_000), random.choice([None, i])) for i in range(400)]
    rows = list({(u, t): (u, t, r) for u, t, r in rows}.values())
    got = warc.earlier_responses(spark.createDataFrame(rows, "url_key string, ts long, response_id long")).collect()
    for r in got:
        before = [(t, x) for u, t, x in rows if u == r.url_key and t < r.ts and x is not None]
        assert r.earlier_id == (max(before)[1] if before else None)
    assert len(got) == len(rows)


def test_repeated_revisits_each_give_a_row(spark):
    rows = [(1, "response", "http://a.com/", 1, 200, {"etag": "x"}, "p")] + [
        (2, "revisit", "http://a.com/", 5, 304, {"etag": "x"}, None)] * 3
    df = spark.createDataFrame([(*r, "clash") for r in rows], RECORDS)
    assert [r.outcome for r in warc.resolve_revisits(df).collect()] == ["resolved"] * 3


def test_licences(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction.\nThe above copyright notice and "
           "this permission notice shall be included in all copies or substantial portions of the Software.")
    texts = [("MIT License\n\n" + mit + " More.", ["MIT"]), ("Hello.  Licensed under CC BY-NC 4.0.\nBye", ["CC-BY-NC-4.0"]),
             ("All rights reserved! Released under the MIT License.", ["Proprietary", "MIT"]), ("MIT License", []),
             ("we reserved a table", []), ("", []), (None, []), ("x " * 200_000 + "\nReleased under the MIT License.", ["MIT"]),
             ("You may not use this file except in compliance with the License.", [])]
    rows = [(i, t, "clash") for i, (t, _) in enumerate(texts)] + [(None, "Released under the MIT license", "c")] * 2
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.licenses == texts[r.doc_id][1], r
            assert r.license == (r.licenses[0] if r.licenses else None)
            for at, name in zip(r.starts, r.licenses, strict=True):
                assert texts[r.doc_id][0][at:].strip() and name
        else:
            assert r.license == "MIT"
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan_licenses(empty).count() == 0


def test_ordered_rules_take_the_first_that_matches():
    s = licenses.Scanner(known=(("a", "alpha one"), ("b", "beta two"), ("c", "gamma three")),
                         rules=(("AB", ("a", "b")), ("A", ("a",)), ("B", ("b",))))
    text = "Alpha one. Beta two. alpha, one! gamma three. beta two. Alpha one"
    assert s.scan(text)[:2] == (["a", "b", "a", "c", "b", "a"], ["AB", "A", "B", "A"])


def test_every_query_has_a_docstring():
    assert all(f.__doc__ for f in QUERIES.values()) and set(SQL) <= set(QUERIES)


def test_canonical_urls(spark):
    pairs = [("http://WWW.A.com:80#x", "a.com/"), ("https://a.com:443/P?q=1#f", "a.com/P?q=1"), ("http://a.com?x", "a.com/?x"),
             ("a.com", None), (None, None), ("http://a.com:8080/", "a.com:8080/")]
    df = spark.createDataFrame(pairs, "u string, w string")
    assert df.where(~warc.canonical_url(F.col("u")).eqNullSafe(F.col("w"))).count() == 0


def test_wrapped_licence_texts():
    """Original notices, wrapped and commented as in files."""
    mit = """ * Copyright (c) 2020 Some One
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in all
 * copies or substantial portions of the Software.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
 * IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
 * FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"""
    isc = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE"""
    bsd = """# Copyright (c) 2020, Some One
# All rights reserved.
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice.
# 3. Neither the name of the copyright holder nor the names of its
#    contributors may be used to endorse or promote products derived from
#    this software without specific prior written permission."""
    gpl = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
//
// This program is distributed in the hope that it will be useful,
// but WITHOUT ANY WARRANTY; without even the implied warranty of
// MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the"""
    mpl = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this */"""
    scan = licenses.Scanner().scan
    assert [scan(t)[1] for t in (mit, isc, bsd, gpl, mpl)] == [
        ["MIT"], ["ISC"], ["BSD-3-Clause"], ["GPL-3.0-or-later"], ["MPL-2.0"]]
    assert scan("All rights\n\nreserved.")[1] == [] and scan("All rights reserved.")[1] == ["Proprietary"]


@pytest.mark.parametrize(("text", "want"), [
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following"
     " conditions\nare met:\n\n1. Redistributions of source code must retain the above notice.\n\n3. Neither the name of the University"
     " nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n   without specific"
     " prior written permission.\n", ["BSD-3-Clause"]),
    ("// SPDX-License-Identifier: MIT\nint x;", ["MIT"]),
    ("# SPDX-License-Identifier: GPL-2.0-or-later\n", ["GPL-2.0-or-later"]),
    (" * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License"
     " as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n *\n"
     " * This program is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty"
     " of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n * GNU General Public License for more details.\n",
     ["GPL-2.0-or-later"]),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense"
     " as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n",
     ["LGPL-2.1-or-later"]),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License"
     " as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version.\n",
     ["AGPL-3.0-or-later"]),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it.", ["Unlicense"]),
    ("This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable.\n\n"
     "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and"
     " redistribute it\nfreely, subject to the following restrictions:\n", ["Zlib"]),
    ("Distributed under the Boost Software License, Version 1.0.\n", ["BSL-1.0"]),
    ("Neither the name of the lake nor its depth is known to anyone here.", []),
])
def test_original_notices(text, want):
    assert licenses.Scanner().scan(text)[1] == want
