"""Item files as a CSV reader takes them: any order of columns, line breaks in cells."""

from tavola.sources.io import CORRUPT, read_items

SCHEMA = "City string, `Dish Name` string, `Price (INR)` double, `Rating Count` int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_files_of_different_headers_and_cells_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('City,Dish Name,Price (INR),Rating Count\nPune,"two\nlines, one cell",5,7\nGoa,plain,NA,5.0\n')
    (tmp_path / "b.csv").write_text('Rating Count,Extra,Dish Name,City\n3,x,"say ""hi""",Delhi\nNaN,y,null,"  "\n')
    (tmp_path / "c.csv").write_text("City,Dish Name,Price (INR),Rating Count\nAgra,tea,1e2,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("City,Rating Count\n")
    got = rows(read_items(spark, str(tmp_path), SCHEMA))
    assert got == sorted([("Pune", "two\nlines, one cell", 5.0, 7), ("Goa", "plain", None, 5), ("Delhi", 'say "hi"', None, 3), ("  ", None, None, None), ("Agra", "tea", 100.0, 2)], key=str)
    some = rows(read_items(spark, [str(tmp_path / "b.csv"), str(tmp_path / "c.csv")], SCHEMA))
    assert [r[0] for r in some] == ["  ", "Agra", "Delhi"]


def test_records_that_do_not_fit_are_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_text("City,Dish Name,Price (INR),Rating Count\nPune,x,cheap,7\nGoa,y,1,2,3\nAgra,z\n")
    got = {r["City"]: r for r in read_items(spark, str(tmp_path), SCHEMA, report_corrupt=True).collect()}
    assert got["Pune"][CORRUPT] == "Pune,x,cheap,7" and got["Pune"]["Price (INR)"] is None and got["Pune"]["Rating Count"] == 7
    assert got["Goa"][CORRUPT] == "Goa,y,1,2,3" and got["Agra"][CORRUPT] is not None and len(got) == 3


def test_no_rows(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    df = read_items(spark, str(tmp_path), SCHEMA)
    assert df.columns == ["City", "Dish Name", "Price (INR)", "Rating Count"] and df.count() == 0
