"""Published results, recomputed from their published inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.stats import binomial_two_sided, harmonic_sum, t_two_sided
from tidemark.operators import fit, reduce, spatial
from tidemark.plans import studies

# A monthly residual from 2016-01 on, None where not observed.
RESIDUAL = [
    26.753061344, 32.852424498, 24.156790761, None, 3.959204908, -6.486302079, -2.825507003, 23.724518597, None, None,
    -5.753648596, 44.855112110, 19.371702472, None, -22.458051084, 12.512325158, 3.991021642, -18.639470693, None, None,
    None, None, None, None, None, None, None, None, None, -8.756308870, 5.990544503, None, None, 21.628618653, 22.983726378,
    15.214814369, 26.891208300, 47.392141713, 38.172651885, 7.551702480, 12.491066146, 36.134672856, 29.041386244, 2.307954827,
    -10.654991310, -5.682326399, 3.550186784, 26.126185963, 13.034379276, 31.026272551, 5.360765722, 2.996277711, 15.246062128,
    37.496160957, 0.842641910, -28.133329749, -9.731883680, 18.249759492, 48.175088256, 27.877810748, 7.305740691, -6.388282058,
    21.726280291, 42.353807400, 36.426933243, 23.510889980, 8.970000189, 30.394045755, 57.043600124, 58.076318273, 16.427479630,
    1.907011379, 5.635613845, 0.036549845, 11.035739665, 17.222854025, 0.966542346, 14.675947750, 12.593301545, 31.887190797,
    44.736116362, 6.681125973, -10.514461044, 3.933591194, 2.331577144, 20.309965046, 22.009021111, -8.257398084, -21.820404977,
    -15.711648976, -13.657413495, -25.850186672, -21.184310881, -24.517410153, -52.599050070, -57.448006924, -40.062275541,
    -32.283106603, -38.128727684, -37.120871576, -1.180011650, -45.581519692, -50.719560161, -38.134771084, -38.164517078,
    -26.424777950, -1.293814747, -10.523298331, -36.755559444, -51.589375186, -42.322399726, -3.326878295, -5.024693313,
    -0.981776334, 0.029590262, -1.556881145, 0.105530767, 1.614680587, 1.020973248, -1.079723701]

# Trends of forty units by basin code.
BY_BASIN = {
    1004: [-9.400955005693913, -12.566105886779932, -14.266052367716044, -10.954266032757918, -12.780151247752643, -12.659020490462352,
           -7.914377990627493, -8.301827787909946, -2.614660270464846],
    2001: [-4.529219694843874, -6.278420938659857, -5.839044628357579, -8.220368354396369, -4.382739304266613, -5.159321943293335,
           -6.573197808274404, -2.104876683987781, -1.7861110193543102, -2.0917161472574897, 0.9053260538745604],
    2004: [-3.055254353947813, -2.9758605746465863, -0.9154998113551792, -4.389274786499449, -2.271567765748407, 0.2564344895136201,
           -5.829131497830534, -3.840851360396126, -8.107087882056646],
    2005: [1.855237056299197, 1.744287617015381, 2.251135512219859, 2.981636644167192, -1.3514048033391086, 0.5603011609676227,
           1.1775181311092502, -6.434412889079511, -4.195362506466803, -2.407187579155816],
    2007: [-8.35248969957378]}

# Moran's I and pair count per distance band.
BAND_I = [(0, 250, 0.6195171475410461, 1069), (250, 500, 0.44279158115386963, 3308), (500, 750, 0.36836159229278564, 4503),
          (750, 1000, 0.30716806650161743, 5729), (1000, 1500, 0.1885356605052948, 14184), (1500, 2000, 0.11768011748790741, 17244),
          (2000, 3000, 0.042409125715494156, 44205), (3000, 4000, 0.047331131994724274, 51817), (4000, 6000, 0.03876955062150955, 114732)]

# Four footprints, and the noise of single units.
FOOTPRINTS = [(7.621497740037138, 318.4814290567542, 0.5917090697450437, 112.44493014959637, 0.23632857692677864),
              (2.8994891799235205, 110.97400557266482, 0.23907543479539672, 120.03856952094604, 0.534012472374222),
              (4.128759861572197, 160.6302692147824, 0.33817567492560846, 124.05049303001972, 0.3670943332475641),
              (1.1540296980855713, 44.75709493420139, 0.10919311724105896, 135.45694318121005, 1.0684059053280734)]
UNIT_NOISE = [
    11.770242963300054, 16.43356978254111, 15.303059561588956, 12.411683146629336, 14.36186685000193, 13.91272725823993, 11.983978392662538,
    16.470090916403315, 13.118701058298639, 11.821247177811008, 14.179862840162231, 11.698909236799285, 11.72230700485767, 19.02064632766875,
    18.207475073078996, 13.464282924719358, 10.630432461876019, 17.234633254609328, 14.77126870487175, 12.509475326985548, 16.852975206847052,
    10.679786537273904, 11.383041850732424, 14.946605054209545, 10.437488397251697, 12.985445523465327, 14.567222183159553, 12.312067209367687,
    10.844187885134614, 18.763857513640726, 10.449643188074715, 9.820864773796279, 10.075757922746082]


def test_trend_fit_matches_published_slope_and_p(spark):
    rows = [(1, dt.date(2016 + i // 12, i % 12 + 1, 1), v) for i, v in enumerate(RESIDUAL)]
    df = spark.createDataFrame(rows, "unit_id bigint, month date, v double")
    r = fit.trend(df, ["unit_id"], "month", "v").first()
    assert r["n"] == 103
    assert r["b_t"] == pytest.approx(-4.404181013662191, abs=1e-7)
    assert r["p_t"] == pytest.approx(0.02453326012834442, abs=1e-8)


def test_eta_squared(spark):
    rows = [(k, v) for k, vs in BY_BASIN.items() for v in vs]
    df = spark.createDataFrame(rows, "g int, y double")
    assert reduce.eta_squared(df, "y", "g").first()["eta_squared"] == pytest.approx(0.6089961070012293, abs=1e-12)


def test_decay_length(spark):
    df = spark.createDataFrame([(float(a), float(b), i, n) for a, b, i, n in BAND_I], "lo_km double, hi_km double, i double, pairs bigint")
    assert spatial.range_km(df).first()[0] == pytest.approx(1344.8362125581364, rel=1e-7)  # published in single precision


def test_multiple_testing_constants(spark):
    c = spark.range(1).select(harmonic_sum(F.lit(1283)).alias("c")).first()["c"]
    assert c == pytest.approx(7.7346, abs=5e-5)
    assert 0.05 / 1283 == pytest.approx(3.8971e-05, abs=5e-10)


def test_sign_tests():
    assert binomial_two_sided(83, 172) == pytest.approx(0.70314, abs=5e-6)
    assert binomial_two_sided(84, 170) == pytest.approx(0.93889, abs=5e-6)
    assert binomial_two_sided(5, 10) == 1.0


def test_t_probability_known_values():
    # df = 1 is the Cauchy law, df = 2 has a closed form.
    assert t_two_sided([1.0], [1.0])[0] == pytest.approx(0.5, abs=1e-14)
    assert t_two_sided([2.0], [2.0])[0] == pytest.approx(1 - 2 / 6 ** 0.5, abs=1e-14)
    assert t_two_sided([0.0], [7.3])[0] == pytest.approx(1.0)


def test_detection_threshold(spark):
    fp = spark.createDataFrame(FOOTPRINTS, "cu_ds_std double, cu_yr double, snr_resid double, n_eff_resid double, se_cu double")
    per = spark.createDataFrame([(v,) for v in UNIT_NOISE], "dsdt_noise double")
    r = studies.detection_threshold(fp, per).first()
    assert r["gamma"] == pytest.approx(0.3046385127962261)
    assert r["calibration"] == pytest.approx(1.4055182260357904)
    assert r["n_eff"] == pytest.approx(122.99773397044305)
    assert r["noise_ref"] == pytest.approx(12.985445523465328)
    assert r["snr_needed"] == pytest.approx(0.25346495588139023)
    assert r["depth_needed"] == pytest.approx(129.64961047746195)
