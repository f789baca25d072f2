from pyspark.sql import functions as F

from headway.llm.lang_id import UNDETERMINED, fit_documents, identify, is_held_out, op8_language_id
from headway.llm.license_scan import scan_licenses

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    got = op8_language_id(spark, SF).join(truth, "doc_id").where("held_out AND n >= 100").toPandas()
    assert len(got) > 200 and (got["lang_pred"] == got["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_defined_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_documents(docs)
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 34 !!", "x"), (4, "é", "x"), (None, "the", "x"), (5, "the and of " * 30_000, "x")]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), *model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == [UNDETERMINED] * 3 and got[1]["score"] == 0
    assert got[4]["lang_pred"] != UNDETERMINED and got[5]["lang_pred"] == "en" and got[5]["score"] > 0.9
    numerals = spark.createDataFrame([(1, "½ ² ³ ½"), (2, "Ⅷ"), (3, "½ é")], "doc_id long, text string")
    assert [r["lang_pred"] == UNDETERMINED for r in identify(numerals, *model).orderBy("doc_id").collect()] == [True, True, False]
    none = identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), *fit_documents(docs.limit(0)))
    assert {r["lang_pred"] for r in none.collect()} == {UNDETERMINED}
    en, fr = (docs.where(f"lang = '{x}'").orderBy(F.length("text").desc()).first()["text"] for x in ("en", "fr"))
    mixed = identify(spark.createDataFrame([(1, en[:3000] + "\n" + fr[:2000])], "doc_id long, text string"), *model).first()
    assert set(mixed["langs"]) == {"en", "fr"} and mixed["lang_pred"] == "en"
    assert spark.range(1).select(is_held_out("id")).first()[0] == (__import__("zlib").crc32(b"0") % 3 == 1)


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [
        (1, "x " * 500 + "Licensed under the Apache License, Version 2.0. " + "y " * 500), (2, "RELEASED under the MIT License!"), (3, "under the MIT"), (4, None), (5, ""), (6, "the Licensed Apache under Version License 2.0"),
        (None, "Licensed under CC BY-NC 4.0."), (7, mit + ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ]
    got = scan_licenses(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, license int")).collect()
    assert sorted(((r["doc_id"] or 0), r["license"]) for r in got) == [(0, "CC-BY-NC-4.0/short"), (1, "Apache-2.0/short"), (2, "MIT/short"), (7, "MIT/grant")]
    one = next(r for r in got if r["doc_id"] == 1)
    assert rows[0][1][one["first_byte"] : one["last_byte"]] == "Licensed under the Apache License, Version 2.0"
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
