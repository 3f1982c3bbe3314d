from wayfold.sources import tracks
from wayfold.streaming import arrivals


def document(times):
    points = "".join(f'<trkpt lat="10.{i}" lon="106.0"><time>2024-01-01T{t}Z</time></trkpt>' for i, t in enumerate(times))
    return f'<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><name>t</name><trkseg>{points}<trkpt lat="1" lon="1"/></trkseg></trk></gpx>'


def test_sessions_of_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gpx").write_text(document(["07:00:00", "07:05:00", "08:00:00"]))
    (tmp_path / "in" / "b.gpx").write_text(document(["07:12:00", "23:00:00"]))
    want = sorted((r.start.strftime("%H:%M"), r.points) for r in arrivals.sessions(tracks.read(spark, f"{tmp_path}/in")).collect())
    assert want == [("07:00", 3), ("08:00", 1), ("23:00", 1)]
    rows = arrivals.sessions(arrivals.arriving(spark, f"{tmp_path}/in"))
    query = rows.writeStream.format("memory").queryName("sessions_seen").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    # the last session stays open, as later points may still join it
    assert sorted((r.start.strftime("%H:%M"), r.points) for r in spark.table("sessions_seen").collect()) == want[:2]
    assert arrivals.sessions(tracks.read(spark, f"{tmp_path}/in").limit(0)).count() == 0
