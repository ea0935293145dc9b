from contextlib import nullcontext

import pytest

from stratum.functions.dates import BadDate, clean_dates, format_of, strict_date
from stratum.sources import files
from stratum.sources.encodings import CODECS, detect_encoding
from stratum.sources.files import PROBE_BYTES, detect_separator, heads, layouts, peek, read_orders, read_unknown, repair_names, validate_columns


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_separators(tmp_path):
    for s in (",", "\t", ";", "|"):
        assert detect_separator([s.join("abc"), s.join("123")]) == s
    assert detect_separator(["a", "b"]) == ","


def test_plain(spark, tmp_path):
    df = read_unknown(spark, put(tmp_path / "a.csv", "Name,Age,City\nAnn,30,Rome\n\nBob,,Oslo\n"))
    assert df.columns == ["Name", "Age", "City"] and rows(df) == [("Ann", 30, "Rome"), ("Bob", None, "Oslo")]


def test_trailing_total_goes(spark, tmp_path):
    df = read_unknown(spark, put(tmp_path / "a.csv", "Name,Value\na,100\ntotal,7\nb,200\nTotal,300\n"))
    assert rows(df) == [("a", 100), ("total", 7), ("b", 200)]


def test_title_and_missing_header(spark, tmp_path):
    df = read_unknown(spark, put(tmp_path / "t.csv", "Report of May\na,b,c,d\n1,2,3,4\n5,6,7,8\n"))
    assert df.columns == ["a", "b", "c", "d"] and df.count() == 2
    df = read_unknown(spark, put(tmp_path / "n.csv", "1,2,x\n4,5,y\n"))
    assert df.columns == ["col_0", "col_1", "col_2"] and rows(df) == [(1, 2, "x"), (4, 5, "y")]


def test_names():
    assert repair_names(["a", " ", "a", "b ", "a"]) == ["a", "col_1", "a_1", "b", "a_2"]


def test_ragged_rows(spark, tmp_path):
    df = read_unknown(spark, put(tmp_path / "r.csv", 'a,b,c\n1,2,3,4\n1,2\n"x,y",5,6\n1,2,3,\n1,2,3,,5\n7,8,9\n'))
    assert rows(df) == [("1", 2, None), ("x,y", 5, 6), ("7", 8, 9)]


def test_missing_tokens_and_empty_columns(spark, tmp_path):
    df = read_unknown(spark, put(tmp_path / "m.csv", "a,b,c,d\n1,NA,x,\n2,null,n/a,\n3,#N/A,y,\n"))
    assert df.columns == ["a", "c"] and rows(df) == [(1, "x"), (2, None), (3, "y")]


def test_types(spark, tmp_path):
    df = read_unknown(spark, put(tmp_path / "y.csv", "i,f,b,s,k\n1,1.5,True,1d,007\n2,2,False,x,008\n"), overrides={"k": "str"})
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string"] and rows(df)[0][4] == "007"


@pytest.mark.parametrize("encoding, mark", [("utf-8-sig", b""), ("utf-16-le", b"\xff\xfe"), ("cp1252", b""), ("gbk", b"")])
def test_encodings(spark, tmp_path, encoding, mark):
    text = "名,b\n中,1\n" if encoding in ("gbk", "utf-16-le") else "né,b\n€,1\n"
    path = tmp_path / "e.csv"
    path.write_bytes(mark + text.encode(encoding))
    df = read_unknown(spark, str(path), encoding="gbk" if encoding == "gbk" else None)
    assert [*df.columns, *rows(df)[0]] == [*text.split("\n")[0].split(","), text.split("\n")[1][0], 1]


def test_encoding_detection():
    assert detect_encoding("né".encode()[:2], True) == "utf-8"
    assert detect_encoding(b"\xff\xfea\x00") == "utf-16-le" and detect_encoding("né".encode("latin-1")) == "cp1252"


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        peek(spark, str(tmp_path / "none.csv"))
    for text in ("", "\n \n", "one\ntwo\n"):
        with pytest.raises(ValueError):
            peek(spark, put(tmp_path / "x.csv", text))


def test_encodings_that_are_found(spark, tmp_path):
    chinese = "名称,数量\n" + "中国北京市,1\n上海,2\n" * 40
    for encoding in ("gbk", "utf-16-le", "utf-16-be", "big5"):
        text = chinese if encoding != "big5" else "名稱,數量\n" + "中國北京市,1\n上海,2\n" * 40
        assert detect_encoding(text.encode(encoding)) == encoding
    df = read_unknown(spark, put(tmp_path / "g.csv", chinese, "gbk"))
    assert df.columns == ["名称", "数量"] and rows(df)[:2] == [("中国北京市", 1), ("上海", 2)]
    assert detect_encoding("été,à la,né\n".encode("cp1252")) == "cp1252"
    assert detect_encoding("né".encode("latin-1"), encodings=["utf-8", "latin-1"]) == "latin-1"


def test_bytes_beyond_the_head(spark, tmp_path):
    """A file whose head is ASCII and whose end is not UTF-8 is read anew in the next encoding."""
    df = read_unknown(spark, put(tmp_path / "l.csv", "a,b\n" + "x,1\n" * 40_000 + "é€,2\n", "cp1252"))
    assert df.where("b = 2").first().a == "é€" and df.count() == 40_001


TEXTS = {
    "gbk": "订单编号,客户名称\n我们在北京的仓库已经发货,请注意查收\n数量有误,请回复\n",
    "big5": "訂單編號,客戶名稱\n我們在台北的倉庫已經出貨,請注意查收\n",
    "shift_jis": "注文番号,お客様名\n東京の倉庫から商品を発送しました,ご確認ください\nカタログ,です\n",
    "euc_jp": "注文番号,お客様名\n東京の倉庫から商品を発送しました,ご確認ください\n",
    "euc_kr": "주문번호,고객이름\n서울 창고에서 상품을 발송했습니다,확인해 주세요\n",
    "cp1251": "Номер заказа,Имя клиента\nМы отправили товар,со склада в Москве\n",
    "koi8_r": "Номер заказа,Имя клиента\nМы отправили товар,со склада в Москве\n",
    "cp1252": "numéro,Straße\nnous avons expédié – “où”,Öl für Ärzte €5\n",
}


@pytest.mark.parametrize("encoding", TEXTS)
def test_encodings_are_told_apart(spark, tmp_path, encoding):
    text = TEXTS[encoding]
    for n in (20, len(text)):
        assert detect_encoding(text[:n].encode(CODECS[encoding])) == encoding
    df = read_unknown(spark, put(tmp_path / "e.csv", text, CODECS[encoding]))
    assert [df.columns, *map(list, rows(df))] == [x.split(",") for x in text.split("\n")[:-1]]


def test_replacement_sign_and_broken_bytes_in_utf8(spark, tmp_path):
    """A replacement sign is a sign like others; a broken byte among lines that only UTF-8 explains does not turn the file into another encoding."""
    assert rows(read_unknown(spark, put(tmp_path / "f.csv", "city,n\nZürich,1\nX\ufffdY,2\n"))) == [("Zürich", 1), ("X\ufffdY", 2)]
    path = tmp_path / "b.csv"
    path.write_bytes("city,n\nZürich,1\nKöln,2\n".encode() + b"x,3\n" * 40_000 + b"bad\xff,4\n")
    df = read_unknown(spark, str(path))
    assert {r.city for r in df.where("n <> 3").collect()} == {"Zürich", "Köln", "bad\ufffd"}


def test_each_file_has_its_own_layout(spark, tmp_path):
    """Swapped headers, a title in one file, other separators and encodings, a file without header, all in one folder."""
    folder = tmp_path / "mixed"
    folder.mkdir()
    put(folder / "a.csv", "id,name\n1,ann\n2,bob\n")
    put(folder / "b.csv", "name,id\nzoe,3\n")
    put(folder / "c.csv", "Report of May\nid,name,more\n4,dan,\nTotal,,\n")
    put(folder / "d.csv", "id;name\n5;müller\n", "cp1252")
    put(folder / "e [1].csv", "name\tid\n中国北京\t6\n", "gbk")
    put(folder / "f.csv", "7,1.5\n8,2.5\n")
    put(folder / "g.csv", "\ufeffid,name,more\r\n9,eve,x\r\n", "utf-16-le")
    put(folder / "h.csv", "")
    assert len(layouts(spark, str(folder))) == 7
    df = read_unknown(spark, str(folder), overrides={"name": "str"})
    found = {r.id: (r.name, r.more) for r in df.where("id is not null").collect()}
    assert found == {1: ("ann", None), 2: ("bob", None), 3: ("zoe", None), 4: ("dan", None), 5: ("müller", None), 6: ("中国北京", None), 9: ("eve", "x")}
    assert df.where("id is null").select("col_0", "col_1").count() == 2


def test_files_without_header_take_the_others_names(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    put(folder / "1.csv", "id,price\n1,2.5\n")
    put(folder / "2.csv", "2,3.5\n3,4.5\n")
    assert sorted(rows(read_unknown(spark, str(folder)))) == [(1, 2.5), (2, 3.5), (3, 4.5)]


def test_heads_are_bounded(spark, tmp_path):
    put(tmp_path / "big.csv", "a,b\n" + "x" * 50 + ",1\n" + "yy,2\n" * 200_000)
    put(tmp_path / "old.csv", "a,b\rz,3\rw,4\r")
    found = {r.file.rsplit("/", 1)[1]: len(r.head) for r in heads(spark, [str(tmp_path)], early=False).collect()}
    assert found["big.csv"] == PROBE_BYTES and found["old.csv"] == len("a,b\rz,3\rw,4\r")
    assert read_unknown(spark, str(tmp_path)).count() == 200_003


def test_files_that_share_a_partition_are_not_missed(spark, tmp_path, monkeypatch):
    """Where pieces of files are packed together after all, the files behind the first are looked at again."""
    for i in range(6):
        put(tmp_path / f"{i}.csv", "a,b\n" + f"{i},1\n" * 30_000)
    put(tmp_path / "empty.csv", "")
    monkeypatch.setattr(files, "_a_split_each", lambda spark: nullcontext())
    df = read_unknown(spark, str(tmp_path))
    assert df.count() == 180_000 and df.select("a").distinct().count() == 6


def test_folder_of_files(spark, tmp_path):
    """Title, header and total are each file's own; patterns name some of the files."""
    folder = tmp_path / "days"
    folder.mkdir()
    put(folder / "1.csv", "Report of May\na,b,c,d\n1,2,3,4\nTotal,9,,\n")
    put(folder / "2.csv", "Report of June\na,b,c,d\n5,6,7,8\n9,9,9,9\nTotal,9,,\n")
    assert sorted(rows(read_unknown(spark, str(folder)))) == [(1, 2, 3, 4), (5, 6, 7, 8), (9, 9, 9, 9)]
    assert rows(read_unknown(spark, f"{folder}/1*.csv")) == [(1, 2, 3, 4)]


ORDERS = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n536365,85123,MUG,6,12/1/2010 8:26,2.55,17850,United Kingdom\nC536366,71053,,1,12/2/2010 8:28,3.39,17851,France\n"


def test_orders(spark, tmp_path):
    df = read_orders(spark, put(tmp_path / "o.csv", ORDERS))
    assert dict(df.dtypes)["InvoiceNo"] == dict(df.dtypes)["CustomerID"] == "string"
    with pytest.raises(ValueError, match="Country"):
        validate_columns(df.drop("Country"))
    with pytest.raises(FileNotFoundError):
        read_orders(spark, str(tmp_path / "gone.csv"))


def test_dates(spark):
    df = spark.createDataFrame([("01/02/2023", "x"), ("13/02/2023", "y"), (None, "z"), ("03/04/2023", None)], "d string, s string")
    out = clean_dates(df, ["d", "s"], 0.4)
    assert dict(out.dtypes) == {"d": "timestamp_ntz", "s": "string"}
    # two days are beyond twelve in neither format; the one that reads more values is taken
    assert [str(r.d) for r in out.collect()] == ["2023-02-01 00:00:00", "2023-02-13 00:00:00", "None", "2023-04-03 00:00:00"]
    assert dict(clean_dates(df.where("d is null or d like '01%'").unionByName(df.where("d is null")).unionByName(df.where("d is null")), ["d"]).dtypes)["d"] == "string"


def test_format_does_not_depend_on_order(spark):
    days = [(f"{i % 28 + 1}/{i % 12 + 1}/2023",) for i in range(200)]
    found = {format_of(spark.createDataFrame(part, "d string").repartition(n), ["d"])["d"] for part, n in (([("31/31/31",), *days], 1), ([*reversed(days), ("x",)], 5))}
    assert found == {"d/M/yyyy"}


def test_strict_dates(spark):
    good = spark.createDataFrame([("12/1/2010 8:26",), (None,), ("12/13/2010 8:26",)], "d string")
    assert [str(r.d) for r in strict_date(good, "d").collect()] == ["2010-12-01 08:26:00", "None", "2010-12-13 08:26:00"]
    with pytest.raises(Exception, match="no date"):
        strict_date(good.unionByName(spark.createDataFrame([("soon",)], "d string")), "d").collect()
    with pytest.raises(BadDate):
        strict_date(spark.createDataFrame([("soon",)], "d string"), "d")
