"""Small budget lines in the full 38-column shape, made by rule, and where the test tables lie."""

from erario import fixed

#: Tables of the smallest size.
SF = "/root/testdata/sf0.001"
COLUMNS = [fixed.PERIOD, fixed.LINE_KEY, *fixed.AMOUNTS, *fixed.TEXTS, *fixed.NUMERIC_IDS]


def line(i: int, **changes) -> dict:
    row = {c: f"{c[-6:]} {i % 4}" for c in fixed.TEXTS}
    row |= {c: str(i % 5 + 1) for c in fixed.NUMERIC_IDS}
    # A number has one name, as in the source.
    row |= {"id_ramo": str(i % 3), "desc_ramo": f"Ramo {i % 3}", "id_ur": "GYR" if i % 2 else "100",
            "desc_ur": f"Unidad {i % 2}"}
    row |= {a: f"{100 + i * 7 + k}.25" for k, a in enumerate(fixed.AMOUNTS)}
    row |= {fixed.PERIOD: "2026", fixed.LINE_KEY: str(i), "tipo_gasto": "PROGRAMABLE"}
    return row | changes


def write_csv(path, rows, encoding="utf-8"):
    import csv

    with open(path, "w", encoding=encoding, newline="") as f:
        out = csv.DictWriter(f, COLUMNS)
        out.writeheader()
        out.writerows(rows)
    return str(path)
