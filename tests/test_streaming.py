from levelground.operators.cloud import terrain, voxel_downsample
from levelground.streaming.clouds import voxels


def test_voxels_of_a_stream_are_those_of_its_points(spark, tmp_path):
    points = terrain(spark, 2.0, 200)
    for i in range(2):
        points.where(f"pid % 2 = {i}").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = voxels(stream, 0.5).writeStream.format("memory").queryName("voxels").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: {(r.vx, r.vy, r.vz): (r.n_points, round(r.z, 9)) for r in df.collect()}
    assert key(spark.table("voxels")) == key(voxel_downsample(points, 0.5))
