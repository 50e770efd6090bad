"""Vocabulary of the domain as small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tag names and numbers.
TAGS = {
    "RoadUserType_Vehicle": 1,
    "RoadUserType_CategoryM_PassengerCar": 2,
    "RoadUserType_CategoryM_Bus": 3,
    "RoadUserType_CategoryM_Minibus": 4,
    "RoadUserType_CategoryN_LCV": 5,
    "RoadUserType_CategoryN_LGV": 6,
    "RoadUserType_CategoryL_Motorcycle": 7,
    "RoadUserType_CategoryL_Moped": 8,
    "RoadUserType_VRU": 9,
    "RoadUserType_VRU_Pedestrian": 10,
    "RoadUserType_VRU_Cyclist": 11,
    "RoadUserType_VRU_Other": 12,
    "EgoVehicle": 13,
    "VehicleLateralActivity_GoingStraight": 14,
    "VehicleLateralActivity_ChangingLane": 15,
    "VehicleLateralActivity_ChangingLane_Left": 16,
    "VehicleLateralActivity_ChangingLane_Right": 17,
    "VehicleLateralActivity_Turning": 120,
    "VehicleLateralActivity_Turning_Left": 18,
    "VehicleLateralActivity_Turning_Right": 19,
    "VehicleLateralActivity_Swerving": 121,
    "VehicleLateralActivity_Swerving_Left": 20,
    "VehicleLateralActivity_Swerving_Right": 21,
    "VehicleLongitudinalActivity_Reversing": 22,
    "VehicleLongitudinalActivity_StandingStill": 23,
    "VehicleLongitudinalActivity_DrivingForward": 24,
    "VehicleLongitudinalActivity_DrivingForward_Braking": 25,
    "VehicleLongitudinalActivity_DrivingForward_Cruising": 26,
    "VehicleLongitudinalActivity_DrivingForward_Accelerating": 27,
    "PedestrianActivity_Walking": 122,
    "PedestrianActivity_Walking_Straight": 28,
    "PedestrianActivity_Walking_TurnLeft": 29,
    "PedestrianActivity_Walking_TurnRight": 30,
    "PedestrianActivity_Stopping": 31,
    "PedestrianActivity_StandingStill": 32,
    "CyclistLateralActivity_GoingStraight": 33,
    "CyclistLateralActivity_Turning": 123,
    "CyclistLateralActivity_Turning_Left": 34,
    "CyclistLateralActivity_Turning_Right": 35,
    "CyclistLateralActivity_Swerving": 124,
    "CyclistLateralActivity_Swerving_Left": 36,
    "CyclistLateralActivity_Swerving_Right": 37,
    "CyclistLongitudinalActivity_RidingForward": 125,
    "CyclistLongitudinalActivity_RidingForward_Decelerating": 38,
    "CyclistLongitudinalActivity_RidingForward_Cruising": 39,
    "CyclistLongitudinalActivity_RidingForward_Accelerating": 40,
    "CyclistLongitudinalActivity_Stopping": 41,
    "CyclistLongitudinalActivity_StandingStill": 42,
    "InitialState_Direction_SameAsEgo": 43,
    "InitialState_Direction_Oncoming": 44,
    "InitialState_Direction_Crossing": 45,
    "InitialState_Dynamics_Moving": 46,
    "InitialState_Dynamics_StandingStill": 47,
    "InitialState_LateralPosition_SameLane": 48,
    "InitialState_LateralPosition_LeftOfEgo": 49,
    "InitialState_LateralPosition_RightOfEgo": 50,
    "InitialState_LateralPosition_OtherLane": 51,
    "InitialState_LongitudinalPosition_InFrontOfEgo": 52,
    "InitialState_LongitudinalPosition_SideOfEgo": 53,
    "InitialState_LongitudinalPosition_RearOfEgo": 54,
    "LeadVehicle_Appearing": 126,
    "LeadVehicle_Appearing_CuttingIn": 55,
    "LeadVehicle_Appearing_GapClosing": 56,
    "LeadVehicle_Disappearing": 127,
    "LeadVehicle_Disappearing_CuttingOut": 57,
    "LeadVehicle_Disappearing_GapOpening": 58,
    "LeadVehicle_Following": 59,
    "Animal_Position_OnEgoPath": 60,
    "Animal_Position_OnRoad": 61,
    "Animal_Position_NextToRoad": 62,
    "Animal_Dynamics_Moving": 63,
    "Animal_Dynamics_Stationary": 64,
    "RoadType_PrincipleRoad": 128,
    "RoadType_PrincipleRoad_Motorway": 65,
    "RoadType_PrincipleRoad_Trunk": 66,
    "RoadType_PrincipleRoad_Primary": 67,
    "RoadType_PrincipleRoad_Secondary": 68,
    "RoadType_PrincipleRoad_Tertiary": 69,
    "RoadType_PrincipleRoad_Unclassified": 70,
    "RoadType_PrincipleRoad_Residential": 71,
    "RoadType_PrincipleRoad_Service": 72,
    "RoadType_Link": 129,
    "RoadType_Link_MotorwayLink": 73,
    "RoadType_Link_TrunkLink": 74,
    "RoadType_Link_PrimaryLink": 75,
    "RoadType_Link_SecondaryLink": 76,
    "RoadType_Link_TertiaryLink": 77,
    "RoadType_Link_Sliproad": 78,
    "RoadType_Pavement": 130,
    "RoadType_Pavement_Footway": 79,
    "RoadType_Pavement_CyclistPath": 80,
    "RoadLayout_Straight": 131,
    "RoadLayout_Straight_Merge": 81,
    "RoadLayout_Straight_Entrance": 82,
    "RoadLayout_Straight_Exit": 83,
    "RoadLayout_Straight_Other": 84,
    "RoadLayout_Curved": 132,
    "RoadLayout_Curved_Merge": 85,
    "RoadLayout_Curved_Entrance": 86,
    "RoadLayout_Curved_Exit": 87,
    "RoadLayout_Curved_Other": 88,
    "RoadLayout_Curved_Left": 152,
    "RoadLayout_Curved_Right": 153,
    "RoadLayout_Junction": 133,
    "RoadLayout_Junction_TrafficLight": 89,
    "RoadLayout_Junction_NoTrafficLight": 90,
    "RoadLayout_PedestrianCrossing": 134,
    "RoadLayout_PedestrianCrossing_TrafficLight": 91,
    "RoadLayout_PedestrianCrossing_NoTrafficLight": 92,
    "Region_EU_North": 143,
    "Region_EU_WestCentral": 144,
    "Region_EU_South": 145,
    "Region_USA_WestCoast": 146,
    "Region_USA_MidWest": 147,
    "Region_USA_East": 148,
    "Region_Japan": 149,
    "Region_China": 150,
    "Region_OtherCountries": 151,
    "StaticObject_OnIntendedPath": 135,
    "StaticObject_OnIntendedPath_Passable": 93,
    "StaticObject_OnIntendedPath_Impassable": 94,
    "StaticObject_ViewBlocking": 95,
    "StaticObject_Other": 96,
    "TrafficLight_Red": 97,
    "TrafficLight_Amber": 98,
    "TrafficLight_Green": 99,
    "TrafficLight_NA": 100,
    "Weather_NoPrecipitation": 101,
    "Weather_Rain": 136,
    "Weather_Rain_Light": 102,
    "Weather_Rain_Moderate": 103,
    "Weather_Rain_Heavy": 104,
    "Weather_Suspension": 137,
    "Weather_Suspension_Mist": 105,
    "Weather_Suspension_Fog": 106,
    "Weather_Suspension_Haze": 107,
    "Weather_Snow": 138,
    "Weather_Snow_Light": 108,
    "Weather_Snow_Moderate": 109,
    "Weather_Snow_Heavy": 110,
    "Lighting_Day": 139,
    "Lighting_Day_ClearSky": 111,
    "Lighting_Day_Cloudy": 112,
    "Lighting_Day_Overcast": 113,
    "Lighting_Twilight": 140,
    "Lighting_Twilight_Dawn": 114,
    "Lighting_Twilight_Dusk": 115,
    "Lighting_Dark": 141,
    "Lighting_Dark_Streetlights": 116,
    "Lighting_Dark_NoStreetlights": 117,
    "Lighting_Glare": 142,
    "Lighting_Glare_Sun": 118,
    "Lighting_Glare_OncomingTraffic": 119,
    "Communication_V2V": 189,
    "Communication_I2V": 190,
    "Communication_V2X": 191,
    "Communication_Network_Wifi": 192,
    "Communication_Network_Cellular": 193,
    "Communication_Network_Its": 194,
}
# Tags below RoadUserType_Vehicle that its name doesn't begin.
VEHICLES = [
    "RoadUserType_CategoryM_PassengerCar",
    "RoadUserType_CategoryM_Bus",
    "RoadUserType_CategoryM_Minibus",
    "RoadUserType_CategoryN_LCV",
    "RoadUserType_CategoryN_LGV",
    "RoadUserType_CategoryL_Motorcycle",
    "RoadUserType_CategoryL_Moped",
]
# Actor types and the tags whose numbers they carry.
ACTOR_TYPES = {
    "Vehicle": "RoadUserType_Vehicle",
    "CategoryM_PassengerCar": "RoadUserType_CategoryM_PassengerCar",
    "CategoryM_Minibus": "RoadUserType_CategoryM_Minibus",
    "CategoryM_Bus": "RoadUserType_CategoryM_Bus",
    "CategoryN_LCV": "RoadUserType_CategoryN_LCV",
    "CategoryN_LGV": "RoadUserType_CategoryN_LGV",
    "CategoryL_Motorcycle": "RoadUserType_CategoryL_Motorcycle",
    "CategoryL_Moped": "RoadUserType_CategoryL_Moped",
    "VRU_Pedestrian": "RoadUserType_VRU_Pedestrian",
    "VRU_Cyclist": "RoadUserType_VRU_Cyclist",
    "VRU_Other": "RoadUserType_VRU_Other",
    "NetworkWifi": "Communication_Network_Wifi",
    "NetworkCellular": "Communication_Network_Cellular",
    "NetworkIts": "Communication_Network_Its",
}
# State variables and their units.
STATE_VARIABLES = {
    "LONGITUDINAL_POSITION": "x [m]",
    "LATERAL_POSITION": "y [m]",
    "SPEED": "v [m/s]",
    "HEADING": "psi [rad]",
    "YAWRATE": "psidot [rad/s]",
    "LONGITUDINAL_ROAD_POSITION": "[ROAD_ID, ROAD_DISTANCE]",
    "LATERAL_ROAD_POSITION": "[LANE_ID, LANE_OFFSET]",
    "LON_TARGET": "[vabs [m/s], dx [m]]",
    "LAT_TARGET": "dy [m]",
    "MESSAGE": "text [str]",
}


def tag_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TAGS.items()), "name string, value int")


def state_variable_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATE_VARIABLES.items()), "name string, unit string")


def actor_type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, TAGS[v]) for k, v in ACTOR_TYPES.items()], "name string, value int")


def covers(sup: str, sub: str) -> bool:
    """Whether a tag covers another: itself, those whose name it begins, and for a vehicle its kinds."""
    return sub.startswith(sup) or (sup == "RoadUserType_Vehicle" and sub in VEHICLES)


def tag_closure(spark: SparkSession) -> DataFrame:
    """sup, sub: every tag with each tag that it covers, some hundred rows. Containment by hierarchy is then an equi-join with
    this small table."""
    return spark.createDataFrame([(a, b) for a in TAGS for b in TAGS if covers(a, b)], "sup string, sub string")
