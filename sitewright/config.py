"""Constants that define the semantics of scores, searches and maps. Fixed values."""

SLOPE_LIMIT_DEG = {"habitat": 5.0, "greenhouse_dome": 5.0, "landing_pad": 3.0, "solar_field": 10.0, "tunnel": 15.0}
#: length, width in metres; circles have one diameter (landing pads by body: Mars, Moon).
RECTANGLES_M = {"habitat": (8.0, 4.0), "tunnel": (6.0, 2.0), "solar_field": (20.0, 20.0)}
CIRCLES_M = {"greenhouse_dome": (10.0, 10.0), "landing_pad": (30.0, 50.0)}
WEIGHTS = {"slope": 30.0, "flatness": 15.0, "cut_fill": 15.0, "science": 15.0, "access": 15.0, "moon_sun": 5.0, "moon_earth": 5.0, "moon_dose": 30.0}
SCIENCE_RANGE_M = (50.0, 500.0)
ROVER_SLOPE_DEG = 30.0
ROVER_GRID_M = {"mars": 4.0, "moon": 10.0}
SLOPE_COST = 0.1
ROVER_SPEED_M_S = 0.042
ROVER_TURN_RAD_S = 0.042 / 1.6
RELEVANCY_SLOPE = 10.0
RELEVANCY_Z = 1.0
KEEP_CHAT, KEEP_CONCEPTS = 100, 12
MOON_RADIUS_M = 1_737_400.0
DOSE_OPEN_SKY = 1369 * 365.25 / 1000
OPACITY_MIN, OCCLUDER_OPACITY, OCCLUSION_SLACK = 0.05, 0.3, 1.08
