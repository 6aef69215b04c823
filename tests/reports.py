"""Small report records for the tests: codes and models in turn; the first three with four kinds of personal
data in two fields, the others with a phone number in each."""

from __future__ import annotations

import json

from medallion.functions.mapping import security_class
from medallion.schemas import REPORT
from pyspark.sql import functions as F

FULL = "reach me: 010-2222-3333 / born 850505-2345678 / mail who@post.example / acct 123-654321-09"
PHONE = "reach me: 010-4444-5555"


def sample_reports(spark, n):
    rows = []
    for i in range(n):
        personal = FULL if i < 3 else PHONE
        rows.append({
            "pilot_problem_no": f"AP{10000 + i:08d}", "reform_numseq": 1, "pilot_project_no": f"P{i}",
            "pilot_vhclmodel_no": f"NX0{i % 3 + 1}", "pilot_step_typecd": "D", "pilot_problem_importnrate_typecd": "SABCD"[i % 5],
            "problem_content": f"현상: door {i} rattles\n원인: loose clip\n{personal}",
            "cntmeasure_content": "대책: tighten the clip", "display_content": f"shown in the list\n{personal}",
            "dept_name": "quality", "reg_empno": f"E{i}", "upd_empno": f"E{i}", "reg_dts": "2025-01-01", "upd_dts": "2025-01-01",
            "parts": json.dumps([{"part_no": f"{i}-{k}", "part_name": f"part {k}", "manfproc_typecd": "ASSY"} for k in range(3)]),
            "steps": json.dumps([{"pilot_step_typecd": s, "step_name": s, "step_date": "2025-01-01"} for s in "DP"]),
        })
    names = [f.name for f in REPORT]
    made = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'reform_numseq' else 'string'}" for c in rows[0]))
    made = made.withColumn("pclrty_class", security_class("pilot_problem_importnrate_typecd"))
    made = made.withColumn("row_hash", F.md5(F.concat("pilot_problem_no", F.lit("||1"))))
    return made.select(*[F.col(c).cast(REPORT[c].dataType) for c in names])
