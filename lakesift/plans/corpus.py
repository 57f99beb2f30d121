"""Inputs of the named queries, in SQL that Spark and DuckDB both read.

The tables hold no Cyrillic, so most detectors need made-up texts: ``SYNTH`` builds one for each order by integer
arithmetic on its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

IDS = """
select o_orderkey as id,
       lpad(cast((o_orderkey * 104729 + 7703000000) % 10000000000 as string), 10, '0') as inn10,
       lpad(cast((o_orderkey * 104729 + 500100000000) % 1000000000000 as string), 12, '0') as inn12,
       lpad(cast((o_orderkey * 104729 + 11223300000) % 100000000000 as string), 11, '0') as snils,
       cast(4276000000000000 + o_orderkey * 104729 as string) as card
from {orders}"""

SYNTH = f"""
select 'synth' as kind, id, concat(
  case id % 5 when 0 then 'Иванов Пётр Сергеевич, ' when 1 then 'Анна Смирнова; Нижний Новгород, '
              when 2 then 'Клиент Кузнецова Мария, Пермь; Олег Белов, ' else 'заявка ' end,
  case id % 7 when 0 then concat('дата рождения: ', lpad(cast(1 + id % 28 as string), 2, '0'), '.0', cast(1 + id % 9 as string), '.19', cast(60 + id % 40 as string), chr(10))
              when 1 then '12/05/2024 и 3 MAY 2021 ' when 2 then '01.02.2003 ' else '' end,
  case id % 6 when 0 then concat('г. Уфа, ул. Мира, ', lpad(cast(id * 37 % 1000000 as string), 6, '0'), '; ')
              when 1 then concat('всего ', lpad(cast(id * 37 % 1000000 as string), 6, '0'), '; ') else '' end,
  case id % 4 when 0 then concat('СНИЛС ', substr(snils, 1, 3), '-', substr(snils, 4, 3), '-', substr(snils, 7, 3), ' ', substr(snils, 10, 2), ' ')
              when 1 then concat('ИНН ', inn10, ' ') when 2 then concat('ИНН ', inn12, ' ') else '' end,
  case id % 11 when 0 then concat('паспорт серия 4510 ', lpad(cast(id * 53 % 1000000 as string), 6, '0'), ', ')
               when 1 then concat('водительское удостоверение ', lpad(cast(id as string), 10, '7'), ' ')
               when 2 then 'P<RUSIVANOV<<PETR<<<<<<<<<<<<<<<< CVV 123 ' else '' end,
  case id % 9 when 0 then concat('карта ', substr(card, 1, 4), ' ', substr(card, 5, 4), ' ', substr(card, 9, 4), ' ', substr(card, 13, 4), ', ')
              when 1 then concat('заказ ', card, ' шт. ')
              when 2 then concat('р/с № 40817', lpad(cast(id as string), 15, '0'), ', БИК 04452', lpad(cast(id % 10000 as string), 4, '0'), ' ') else '' end,
  case id % 13 when 0 then 'диагноз: здоров, медицинская карта ' when 1 then 'отпечаток пальца, лицевой счёт '
               when 2 then 'Passport No 12, Surname, Given names, date of expiry ' when 3 then 'политическая партия ' else '' end,
  case id % 17 when 0 then concat('user', cast(id as string), '@example.com ') when 1 then concat('+7 (912) 345-67-', lpad(cast(id % 100 as string), 2, '0'), ' ') else '' end
) as text
from ({IDS}) ids"""

CORPUS = f"""
select 'document' as kind, doc_id as id, coalesce(text, '') as text from {{documents}}
union all select 'page' as kind, page_id as id, coalesce(html, '') as text from {{pages}}
union all {SYNTH}"""

# Headers (hexadecimal) and names on which format detection is tried.
HEADERS = (
    ("255044462d312e37", "a.pdf"), ("255044462d312e37", "a.txt"), ("25504446", "short.pdf"), ("504b03041400", "b.docx"), ("504b03041400", "b.txt"),
    ("d0cf11e0a1b11ae100", "c.doc"), ("7b5c727466312e30", "c.rtf"), ("89504e470d0a1a0a00", "d.png"), ("ffd8ffe000", "d.JPG"), ("ffd8ffe000", "d.png"),
    ("4749463839610a", "e.gif"), ("424d00", "e.bmp"), ("49492a0008", "f.tif"), ("4d4d002a00", "f.tiff"), ("0000001866747970", "g.mp4"),
    ("524946460000", "g.avi"), ("4f67675300", "g.ogg"), ("1f8b0800", "h.gz"), ("377abcaf271c00", "h.7z"), ("526172211a0700", "h.rar"),
    ("53514c69746520666f726d6174203300aa", "i.db"), ("7f454c4602", "j"), ("4d5a9000", "j.exe"), ("3c3f786d6c2076", "k.xml"), ("3c68746d6c3e", "k.html"),
    ("50415231aa", "l.parquet"), ("202020203c48544d4c3e", "m.txt"), ("207b2261223a20317d", "n.json"), ("706c61696e2074657874", "o.md"), ("", "p.pdf"),
    ("", "p"), ("", "p.docx"), ("d0bfd180d0b8", "q.csv"), ("d0bfd180d0b8", "q.xml"), ("00010203", "r.bin"), ("00010203", "r.mp4"), ("00010203", "r.jpeg"), ("00010203", "r.zip"),
)


def read(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of kind, id and text: documents, pages, and a made-up text for each order."""
    return spark.sql(CORPUS, **read(spark, sf_dir, "documents", "pages", "orders"))


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(IDS, **read(spark, sf_dir, "orders"))
