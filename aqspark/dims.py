"""Limits, breakpoints, labels and small lookup tables.

Everything in this module is a constant that results depend on. Tables here
have a size fixed in the source, so joining or inlining them is always bounded.
"""

# --- fixed values: bounds of the country, degrees --------------------------
INDIA_LATITUDES = (6, 37)
INDIA_LONGITUDES = (68, 97)

# --- fixed values: cities -------------------------------------------------
CITY_COORDINATES = {
    "Delhi": (28.6139, 77.2090),
    "Mumbai": (19.0760, 72.8777),
    "Kolkata": (22.5726, 88.3639),
    "Chennai": (13.0827, 80.2707),
    "Bangalore": (12.9716, 77.5946),
    "Hyderabad": (17.3850, 78.4867),
    "Pune": (18.5204, 73.8567),
    "Ahmedabad": (23.0225, 72.5714),
    "Lucknow": (26.8467, 80.9462),
    "Jaipur": (26.9124, 75.7873),
    "Varanasi": (25.3176, 82.9739),
    "Patna": (25.6093, 85.1376),
    "Gurgaon": (28.4595, 77.0266),
    "Noida": (28.5355, 77.3910),
    "Faridabad": (28.4089, 77.3178),
    "Chandigarh": (30.7333, 76.7794),
    "Bhopal": (23.2599, 77.4126),
    "Amritsar": (31.6340, 74.8723),
    "Agra": (27.1767, 78.0081),
    "Kanpur": (26.4499, 80.3319),
}

CITY_POPULATION_MILLIONS = {
    "Delhi": 32.0,
    "Mumbai": 21.0,
    "Kolkata": 15.0,
    "Chennai": 12.0,
    "Bangalore": 14.0,
    "Hyderabad": 10.0,
    "Pune": 8.0,
    "Ahmedabad": 8.0,
    "Lucknow": 4.0,
    "Jaipur": 4.0,
}

EXPECTED_CITIES = [
    "Delhi", "Mumbai", "Kolkata", "Chennai", "Bangalore", "Hyderabad", "Pune", "Ahmedabad",
]

# --- fixed values: parameters ---------------------------------------------
PARAMETERS = ["pm25", "pm10", "so2", "no2", "o3", "co", "nh3", "aqi"]
STORED_PARAMETERS = ["pm25", "pm10", "so2", "no2", "o3", "co", "nh3", "aqi", "pb"]

PARAMETER_RANGES = {
    "pm25": (0.0, 999.0),
    "pm10": (0.0, 999.0),
    "so2": (0.0, 1000.0),
    "no2": (0.0, 1000.0),
    "o3": (0.0, 500.0),
    "co": (0.0, 50.0),
    "nh3": (0.0, 1000.0),
    "aqi": (0.0, 500.0),
}

CHECK_RANGES = {
    "pm25": (0.0, 999.0),
    "pm10": (0.0, 999.0),
    "so2": (0.0, 1000.0),
    "no2": (0.0, 1000.0),
    "o3": (0.0, 500.0),
    "co": (0.0, 50.0),
    "aqi": (0.0, 500.0),
}

STATION_PARAMETER_NAMES = {
    "PM2.5": "pm25",
    "PM10": "pm10",
    "SO2": "so2",
    "NO2": "no2",
    "O3": "o3",
    "CO": "co",
    "NH3": "nh3",
    "Pb": "pb",
}

POLLUTANT_STANDARDS = {
    "pm25": 60.0, "pm10": 150.0, "so2": 80.0, "no2": 80.0, "o3": 100.0, "co": 4.0, "nh3": 400.0,
}

POLLUTANT_LIMITS = {  # (WHO, national)
    "pm25": (15.0, 60.0),
    "pm10": (45.0, 150.0),
    "no2": (25.0, 100.0),
    "o3": (60.0, 70.0),
    "so2": (40.0, 75.0),
    "co": (4.0, 9.0),
}

SOURCE_PRIORITY = {"cpcb": 0, "openaq": 1}
OTHER_SOURCE_PRIORITY = 2

# --- fixed values: index bands --------------------------------------------
# (low, high, label); integer bands, so 50.5 falls in no band
CPCB_BANDS = [
    (0, 50, "Good"),
    (51, 100, "Satisfactory"),
    (101, 200, "Moderate"),
    (201, 300, "Poor"),
    (301, 400, "Very Poor"),
    (401, 500, "Severe"),
]
PORTAL_BANDS = [
    (0, 50, "Good"),
    (51, 100, "Satisfactory"),
    (101, 200, "Moderately Polluted"),
    (201, 300, "Poor"),
    (301, 400, "Very Poor"),
    (401, 500, "Severe"),
]
EPA_BANDS = [
    (0, 50, "Good"),
    (51, 100, "Moderate"),
    (101, 150, "Unhealthy for Sensitive"),
    (151, 200, "Unhealthy"),
    (201, 300, "Very Unhealthy"),
    (301, 500, "Hazardous"),
]
ZONE_BANDS = [
    (0, 50, "green_zone"),
    (51, 100, "yellow_zone"),
    (101, 200, "orange_zone"),
    (201, 300, "red_zone"),
    (301, 400, "purple_zone"),
    (401, 500, "maroon_zone"),
]
# upper bounds of the continuous scales; the last label has no bound
AQI_CUTS = [(50, "Good"), (100, "Satisfactory"), (200, "Moderate"), (300, "Poor"), (400, "Very Poor")]
PM25_CUTS = [(30, "Good"), (60, "Satisfactory"), (90, "Moderate"), (120, "Poor"), (250, "Very Poor")]
TOP_LABEL = "Severe"
RISK_SCORE_CUTS = [(50, 1), (100, 2), (150, 3), (200, 4), (300, 5)]
RISK_SCORE_TOP = 6
RISK_SCORE_LABELS = {1: "Low", 2: "Low-Moderate", 3: "Moderate", 4: "High", 5: "Very High", 6: "Extreme"}

# (concentration low, high, index low, high)
CPCB_PM25_BREAKPOINTS = [
    (0, 30, 0, 50), (31, 60, 51, 100), (61, 90, 101, 200),
    (91, 120, 201, 300), (121, 250, 301, 400), (251, 500, 401, 500),
]
EPA_TRAINING_PM25_BREAKPOINTS = [
    (0, 12.0, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150),
    (55.5, 150.4, 151, 200), (150.5, 250.4, 201, 300), (250.5, 500.4, 301, 500),
]
EPA_BREAKPOINTS = {
    "pm25": [
        (0.0, 12.0, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150), (55.5, 150.4, 151, 200),
        (150.5, 250.4, 201, 300), (250.5, 350.4, 301, 400), (350.5, 500.4, 401, 500),
    ],
    "pm10": [
        (0, 54, 0, 50), (55, 154, 51, 100), (155, 254, 101, 150), (255, 354, 151, 200),
        (355, 424, 201, 300), (425, 504, 301, 400), (505, 604, 401, 500),
    ],
    "no2": [
        (0, 53, 0, 50), (54, 100, 51, 100), (101, 360, 101, 150), (361, 649, 151, 200),
        (650, 1249, 201, 300), (1250, 1649, 301, 400), (1650, 2049, 401, 500),
    ],
    "o3": [
        (0, 54, 0, 50), (55, 70, 51, 100), (71, 85, 101, 150), (86, 105, 151, 200), (106, 200, 201, 300),
    ],
}

# --- fixed values: health -------------------------------------------------
IMPACT_SCORE_BANDS = [(0, 50, 0), (51, 100, 1), (101, 200, 2), (201, 300, 3), (301, 400, 4), (401, 500, 5)]
RELATIVE_RISK_BANDS = [
    (0, 50, 1.0), (51, 100, 1.15), (101, 200, 1.5), (201, 300, 2.2), (301, 400, 3.5), (401, 500, 5.0),
]
BASELINE_RATES_PER_100K = {
    "respiratory_er_visits": 500,
    "asthma_attacks": 300,
    "cv_hospitalizations": 200,
    "premature_deaths": 50,
}
DEMOGRAPHICS = {  # group: (vulnerability multiplier, share of population)
    "children_0_5": (2.5, 0.10),
    "children_6_14": (1.8, 0.15),
    "elderly_65_plus": (2.2, 0.07),
    "adults_with_asthma": (2.0, 0.05),
    "adults_with_heart_disease": (2.3, 0.04),
    "pregnant_women": (1.9, 0.03),
    "outdoor_workers": (1.7, 0.15),
    "general_adults": (1.0, 0.41),
}
GROUP_SENSITIVITY = {"general": 1.0, "children": 1.3, "elderly": 1.4, "respiratory": 1.6, "athletes": 1.2}
ACTIVITY_EXPOSURE = {"sedentary": 0.7, "light": 0.85, "moderate": 1.0, "heavy": 1.3}
PERSONAL_RISK_CUTS = [(20, "Low"), (40, "Moderate"), (60, "High"), (80, "Very High")]
PERSONAL_RISK_TOP = "Extreme"
SENSITIVE_GROUPS = [  # (index must exceed, groups added)
    (50, ["People with respiratory conditions"]),
    (100, ["Children", "Elderly"]),
    (150, ["Outdoor workers", "Athletes"]),
    (200, ["General population"]),
]
RECOMMENDATIONS = [  # (index at most, [(category, message, priority)]); None has no bound
    (50, [("outdoor", "Air quality is good. Enjoy outdoor activities!", "low")]),
    (100, [("outdoor", "Moderate air quality. Sensitive individuals should limit prolonged outdoor exertion.", "medium")]),
    (150, [
        ("outdoor", "Unhealthy for sensitive groups. Consider reducing outdoor activities.", "high"),
        ("protection", "Wear N95 mask if going outdoors.", "medium"),
    ]),
    (200, [
        ("outdoor", "Unhealthy air quality. Avoid prolonged outdoor activities.", "high"),
        ("protection", "Wear N95 mask outdoors. Use air purifiers indoors.", "high"),
    ]),
    (300, [
        ("outdoor", "Very unhealthy. Avoid all outdoor physical activities.", "high"),
        ("health", "Keep rescue medication accessible if you have asthma.", "high"),
    ]),
    (None, [
        ("emergency", "Hazardous air quality. Stay indoors with windows closed.", "high"),
        ("health", "Seek medical attention if experiencing breathing difficulty.", "high"),
    ]),
]
PRECAUTION_GROUPS = ["children", "elderly", "respiratory"]
ACTIVITIES = [  # (index at most, outdoor, indoor)
    (50, ["Running", "Cycling", "Hiking", "Playground", "Yoga in the park"],
     ["Any indoor activity is fine", "Consider outdoor activities today!"]),
    (100, ["Light jogging", "Walking", "Cycling (moderate)", "Gardening"],
     ["Gym workout", "Swimming", "Yoga", "Indoor sports"]),
    (150, ["Short walks only", "Light activities for short periods"],
     ["Gym workout", "Swimming", "Yoga", "Home exercises", "Indoor sports"]),
    (200, ["Avoid outdoor activities", "Use N95 mask if going outside"],
     ["Home exercises", "Yoga", "Meditation", "Indoor hobbies"]),
    (None, ["Stay inside!", "Seal windows and doors", "Use air purifiers"],
     ["Home exercises only", "Use air purifiers", "Meditation", "Read and relax"]),
]
WARNINGS = [  # (index must exceed, warnings added)
    (50, ["Children should limit prolonged outdoor exertion"]),
    (100, ["Elderly individuals should stay indoors", "People with asthma should carry inhalers"]),
    (150, ["People with heart or lung disease should avoid outdoor activity",
           "Outdoor workers should use protective equipment"]),
    (200, ["Everyone should avoid outdoor physical activities", "Pregnant women should stay indoors"]),
    (300, ["EMERGENCY: Everyone should remain indoors", "Keep windows and doors closed"]),
]
IMPACT_TEXT = [  # (low, high, general population, sensitive groups)
    (0, 50, "Air quality is satisfactory, and air pollution poses little or no risk.",
     "No health concern."),
    (51, 100, "Air quality is acceptable. However, there may be a risk for some people.",
     "People with respiratory disease may experience moderate effects."),
    (101, 200, "Members of sensitive groups may experience health effects.",
     "People with lung disease, older adults, children are at greater risk."),
    (201, 300, "Everyone may begin to experience health effects.",
     "People with heart/lung disease, older adults, children at serious risk."),
    (301, 400, "Health alert: everyone may experience more serious health effects.",
     "Emergency conditions. All sensitive groups at severe risk."),
    (401, 500, "Health warning of emergency conditions. Entire population affected.",
     "Life-threatening conditions for sensitive groups."),
]
VULNERABILITY_BINS = [(0, 20, "Low"), (20, 40, "Moderate"), (40, 60, "High"), (60, 80, "Very High"), (80, 100, "Critical")]

# --- fixed values: weather and calendar -----------------------------------
WEATHER_COLUMNS = [
    "temperature_2m", "relative_humidity_2m", "dew_point_2m", "wind_speed_10m", "wind_direction_10m",
    "surface_pressure", "precipitation", "rain", "cloud_cover", "visibility",
]
HOURLY_WEATHER_VARIABLES = [
    "temperature_2m", "relative_humidity_2m", "dew_point_2m", "wind_speed_10m", "wind_speed_100m",
    "wind_direction_10m", "wind_direction_100m", "surface_pressure", "precipitation", "rain",
    "cloud_cover", "cloud_cover_low", "cloud_cover_mid", "cloud_cover_high", "visibility",
]
DAILY_WEATHER_VARIABLES = [
    "temperature_2m_max", "temperature_2m_min", "temperature_2m_mean", "precipitation_sum",
    "precipitation_hours", "wind_speed_10m_max", "wind_gusts_10m_max", "sunshine_duration", "uv_index_max",
]
WIND_BINS = [  # right-closed (low, high, label); None has no bound
    (0, 1.5, "Calm"), (1.5, 3.3, "Light"), (3.3, 5.4, "Gentle"),
    (5.4, 7.9, "Moderate"), (7.9, 10.7, "Fresh"), (10.7, None, "Strong"),
]
SEASON_MONTHS = {
    "winter": [12, 1, 2], "spring": [3, 4, 5], "monsoon": [6, 7, 8, 9], "autumn": [10, 11],
}
TIME_PERIODS = [(7, 10, "morning_rush"), (11, 16, "midday"), (17, 20, "evening_rush")]
TIME_PERIOD_REST = "night"
RUSH_HOURS = [8, 9, 10, 17, 18, 19]
RUSH_HOURS_EARLY = [7, 8, 9, 17, 18, 19]
HOLIDAYS = [
    "2024-01-26", "2024-03-25", "2024-03-29", "2024-04-14",
    "2024-04-21", "2024-05-20", "2024-06-17", "2024-08-15",
    "2024-10-02", "2024-10-12", "2024-11-01", "2024-12-25",
    "2025-01-26", "2025-03-14", "2025-03-31", "2025-04-14",
    "2025-04-18", "2025-05-12", "2025-06-07", "2025-08-15",
    "2025-10-02", "2025-10-20", "2025-11-05", "2025-12-25",
]
AQI_ONE_HOT_BINS = [
    (0, 50, "good"), (50, 100, "moderate"), (100, 150, "unhealthy_sensitive"),
    (150, 200, "unhealthy"), (200, 300, "very_unhealthy"), (300, 500, "hazardous"),
]
LAG_HOURS = [1, 3, 6, 12, 24, 48, 168]
BUILDER_LAGS = [1, 2, 3, 6, 12, 24, 48, 168]
ROLLING_WINDOWS = [3, 6, 12, 24, 48, 168]

# --- fixed values: forecast accuracy and drift ----------------------------
ERROR_BINS = [
    (-500, -200, "<-200"), (-200, -100, "-200:-100"), (-100, -50, "-100:-50"), (-50, -20, "-50:-20"),
    (-20, -10, "-20:-10"), (-10, 0, "-10:0"), (0, 10, "0:10"), (10, 20, "10:20"), (20, 50, "20:50"),
    (50, 100, "50:100"), (100, 200, "100:200"), (200, 500, ">200"),
]
RETRAIN_HOURS = {"daily": 24, "weekly": 168, "monthly": 720}
NORMAL_Z_95 = 1.959963984540054

# --- fixed values: alerts -------------------------------------------------
ALERT_CONDITIONS = [
    "AQI>100", "AQI>150", "AQI>200", "AQI>300", "PM25>35", "PM25>55", "PM25>150", "PM10>150",
    "O3>0.07", "NO2>0.05", "SO2>0.075", "CO>9",
]
ALERT_PATTERN = r"^(AQI|PM25|PM10|O3|NO2|SO2|CO)>(\d+\.?\d*)$"
COOLDOWN_SECONDS = {"realtime": 900, "hourly": 3600, "daily": 86400}
DEFAULT_COOLDOWN_SECONDS = 3600

# --- fixed values: factors of a personal profile ({}: its conditions) -------
PROFILE_FACTORS = [
    ("child", "Child — Higher sensitivity", "warning"),
    ("senior", "Senior — Higher sensitivity", "warning"),
    ("conditions", "Has {} — Extra caution needed", "danger"),
    ("pregnant", "Pregnancy — Avoid polluted areas", "danger"),
    ("active", "High outdoor activity — Increased exposure risk", "warning"),
    ("mask", "Uses mask — Partial protection", "good"),
    ("purifier", "Has air purifier — Better indoor protection", "good"),
]

# --- fixed values: weather statistics of the rollups ------------------------
FULL_STATISTICS = ["mean", "std", "min", "max", "median"]
WEATHER_STATISTICS = {
    "hour": {c: FULL_STATISTICS for c in (
        "temperature_2m", "relative_humidity_2m", "wind_speed_10m", "precipitation", "surface_pressure")},
    "day": {
        "temperature_2m": ["mean", "min", "max"],
        "relative_humidity_2m": ["mean", "min", "max"],
        "wind_speed_10m": ["mean", "max"],
        "wind_direction_10m": ["mean"],
        "precipitation": ["sum", "max"],
        "surface_pressure": ["mean"],
    },
    "week": {c: FULL_STATISTICS for c in ("temperature_2m", "relative_humidity_2m", "wind_speed_10m", "precipitation")},
    "month": {c: FULL_STATISTICS for c in ("temperature_2m", "relative_humidity_2m", "wind_speed_10m", "precipitation")},
}
