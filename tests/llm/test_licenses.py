import re

from quern.llm import licenses

EXTRA = [
    (8001, None), (8002, ""), (8003, "..."), (8004, "The MIT License, THE mit\nlicense the-mit-license"), (8005, "cc by nc CC-BY-NC ccc by nc cc éby nc"),
    (8006, "Apache License, Version 2.0 and the mit license"), (8007, "word " * 30000 + "the mit license"), (8008, "This work is licensed under the GNU General Public License, version 3."),
    (8009, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"), (8004, "license"), (8010, "Kelvin \u212a: released under the m\u0130t license. Permission is hereby granted, free of charge, to any person who gets this software to use, copy, modify, merge, publish, distribute, sublicense copies"),
    (8011, licenses.TEMPLATES[-7][1].replace("conditions", "terms").replace("merge ", "") + " " + licenses.TEMPLATES[-6][1]), (None, "cc by sa 4.0 licensed under cc by sa 4 0"),
]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), w


def method(w, templates):
    """Labels and best share of the method by trying every start of every template."""
    labels, best = set(), 0.0
    idf = {x: p for t in templates for x, _, p in t.lookups}
    own = sorted(set(w) & set(idf), key=lambda x: (-idf[x], x))
    for t in templates:
        looked = [x for x in own if x in {x for x, _, _ in t.lookups}][: licenses.LOOKUPS]
        for s in range(-len(t.words), len(w)):
            get = lambda i: w[s + i] if 0 <= s + i < len(w) else None  # noqa: B023, E731
            share = sum(p for x, i, p in t.lookups if x in looked and get(i) == x) / t.mass
            if all(get(t.key_at + k) == x for k, x in enumerate(t.key)) and share > 0 and (t.base or share >= licenses.LEAST_SHARE):
                labels.add(t.label)
                best = max(best, 1.0 if t.base else min(share, 1.0))
    return ",".join(sorted(labels)), best


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + EXTRA
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as words", "2 as labels")
    templates = licenses.index(*licenses.document_frequencies(df))
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in licenses.scan(df).collect()), key=str)
    want = []
    for d, t in rows:
        *base, w = brute(t)
        labels, best = method(w[-200:] if len(w) > 20000 else w, templates)
        want.append((d, *base, labels, round(best, 9)))
    assert got == sorted(want, key=str)
    assert {r[5] for r in got} >= {"mit", "apache-2", "cc-by-nc", "apache-2,mit"}
    assert dict((r[0], r[6]) for r in got)[8008] == "gpl-3" and dict((r[0], r[6]) for r in got)[8009] == "bsd"


def test_base_sql(spark, tmp_path):
    import duckdb

    rows = [(d, t) for d, t in EXTRA if d != 8007] + [(8020, "the\tmit\x7flicense cc by nc"), (8021, "tHe MIT licenſe \u212a")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = sorted(con.execute(licenses.BASE_SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in licenses.base_phrases(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == want


def test_contract_phrases(spark, tmp_path):
    from quern.llm.queries import op4_license_scan

    rows = [(1, "The MIT License"), (2, "Released under the MIT license, or under the-mit license."), (3, "under mit license the mit license"), (4, "UNDER THE MIT LICENSE cc by nc"), (5, "a" + "\u0301 under the mit licenses"), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in op4_license_scan(spark, str(tmp_path)).collect()}
    assert got == {
        1: (3, 0, None, None, "", "mit"), 2: (10, 2, 1, 6, "mit", "mit"), 3: (6, 0, None, None, "", "mit"), 4: (7, 2, 0, 4, "cc-by-nc,mit", "cc-by-nc,mit"), 5: (5, 0, None, None, "", ""), 6: (0, 0, None, None, "", ""),
    }


def test_plan_is_native_and_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = licenses.scan(df)
    assert out.count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
