"""Both e-commerce pipelines through three layers from small CSV files."""

import uuid

from pyspark.sql import functions as F

from tierlake.plans.medallion import dimension_layers, fact_layers
from tierlake.plans.stages import run_layers
from tierlake.session import scratch_path
from tierlake.sources import events as ev

CSV = {
    "brands": """brand_code,brand_name,category_code
ACME,AcmeTech,CE
NO-VW,  NovaWave ,CE
BK#1,Booky,BOOKS
TOYZ,Toyz,TOYS
ORPH,Orphan,ZZ
""",
    "category": """category_code,category_name
ce,Electronics
bks,Books
toy,Toys
app,Apparel
APP,Apparel
""",
    "products": """product_id,sku,category_code,brand_code,color,size,material,weight_grams,length_cm,width_cm,height_cm,rating_count
P1,S1,ce,acme,red,M,Coton,500g,"12,5",1.0,2.0,-4
P2,S2,bks,bk1,blue,S,Steel,1.5kg,3,1.0,2.0,
P3,S3,ce,orph,red,M,Ruber,200g,4,1.0,2.0,5
""",
    "customers": """customer_id,phone,country_code,country,state
C1,,IN,India,KA
C2,555,CA,Canada,XX
,777,IN,India,MH
C4,888,IN,India,
C5,999,US,United States,TX
C6,111,AU,Australia,NSW
""",
    "date": """date,year,day_name,quarter,week_of_year
01-08-2025,2025,friday,3,-31
02-08-2025,2025,SATURDAY,3,-31
03-08-2025,2025,SUNDAY,,-31
01-08-2025,2025,friday,3,-31
""",
    "order_items": """dt,order_ts,customer_id,order_id,item_seq,product_id,quantity,unit_price_currency,unit_price,discount_pct,tax_amount,channel,coupon_code
2025-08-01,2025-08-01 22:53:52,C1,O1,1,P1,Two, usd ,$12.5,5%,INR 12.30,web, SAVE10
2025-08-01,01-08-2025 22:53,C1,O1,01,P2,3,EUR,10,5,-3,app,
2025-08-02,2025-08-02 10:00:00,C2,O2,1,P3,1,INR,100,0,0,Store,X
""",
}


def test_dimension_and_fact_layers(spark, tmp_path):
    raw = {}
    for name, text in CSV.items():
        d = tmp_path / name
        d.mkdir()
        (d / f"{name}.csv").write_text(text)
        raw[name] = str(d / "*.csv")
    root = scratch_path(spark, "t_medallion")
    tel = f"{root}/telemetry"
    batch = str(uuid.uuid4())
    run_layers(spark, dimension_layers(spark, raw, root), tel, batch)
    run_layers(spark, fact_layers(spark, raw["order_items"], root), tel, batch)

    evs = ev.read_events(spark, tel).where(F.col("batch_id") == batch)
    ex = evs.where("event_type = 'execution'").collect()
    assert len(ex) == 16 and {e.status for e in ex} == {"SUCCESS"}

    table_of = evs.where("event_type = 'lineage'").select("artifact_id", "downstream_table",
                                                          "upstream_tables")
    an = {(r.downstream_table, r.anomaly_type) for r in
          evs.where("event_type = 'anomaly'").select("artifact_id", "anomaly_type")
          .join(table_of, "artifact_id").collect()}
    assert ("silver.slv_category", "DUPLICATE_PRIMARY_KEYS") in an        # app / APP
    assert ("bronze.brz_customers", "NULL_PRIMARY_KEY") not in an         # quarantined instead
    assert ("gold.gld_date", "LOW_ROW_COUNT") in an                       # 3 dates < 10
    assert ("silver.slv_fact_order_items", "DUPLICATE_PRIMARY_KEYS") in an  # 1 and 01
    assert ("gold.gld_fact_order_items", "MISSING_BUSINESS_METRIC") in an   # EUR: no rate
    assert ("gold.gld_customers", "LOW_ROW_COUNT") not in an              # 5 customers kept

    q = evs.where("event_type = 'quarantine_record'").collect()
    assert len(q) == 1 and '"phone":"777"' in q[0].raw_record
    drift = {r.downstream_table for r in
             evs.where("event_type = 'schema_drift'").select("artifact_id")
             .join(table_of, "artifact_id").collect()}
    assert {"bronze.brz_products", "bronze.brz_order_items"} <= drift
    ups = {r.downstream_table: sorted(r.upstream_tables) for r in table_of.collect()}
    assert ups["gold.gld_products"] == ["silver.slv_brands", "silver.slv_category",
                                         "silver.slv_products"]

    prod = {r.product_id: r for r in spark.read.parquet(f"{root}/gold/gld_products").collect()}
    assert prod["P1"].brand_name == "AcmeTech" and prod["P1"].material == "Cotton"
    assert prod["P3"].brand_name == "Not Available" and prod["P2"].weight_grams is None
    cust = {r.customer_id: r.region for r in
            spark.read.parquet(f"{root}/gold/gld_customers").collect()}
    assert cust == {"C1": "South", "C2": "Other", "C4": "Other", "C5": "South", "C6": "East"}
    fact = {(r.transaction_id, r.product_id): r for r in
            spark.read.parquet(f"{root}/gold/gld_fact_order_items").collect()}
    # gross 2 * 12.5 = 25; discount ceil(1.25) = 2; net 25 - 2 + 12.3 = 35.3; ceil(35.3 * 88.29)
    assert fact[("O1", "P1")].net_amount == 35.3 and fact[("O1", "P1")].net_amount_inr == 3117
    assert fact[("O1", "P1")].coupon_flag == 1
    assert fact[("O1", "P2")].net_amount_inr is None and fact[("O1", "P2")].coupon_flag == 0


def test_command_line_run_and_diagnose(spark, tmp_path, capsys):
    from tierlake import __main__ as cli
    raw = tmp_path / "raw"
    for name, text in CSV.items():
        (raw / name).mkdir(parents=True)
        (raw / name / f"{name}.csv").write_text(text)
    root = scratch_path(spark, "t_cli")
    assert cli.main(["run", "dims", "--raw", str(raw), "--root", root]) == 0
    assert cli.main(["run", "facts", "--raw", str(raw), "--root", root]) == 0
    report = cli.diagnose(spark, f"{root}/telemetry")
    # no failure: the newest anomaly is from the fact gold table
    assert report["incident"]["incident_type"] == "anomaly"
    assert report["incident"]["table"] == "gold.gld_fact_order_items"
    nodes = [c["node"] for c in report["root_causes"]]
    assert nodes[0] == "bronze.brz_order_items"  # most upstream table with evidence (drift)
    assert cli.main(["diagnose", "--telemetry", f"{root}/telemetry"]) == 0
    assert "incident: anomaly at gold.gld_fact_order_items" in capsys.readouterr().out
