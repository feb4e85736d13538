"""Declared types of sources and operators."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_INT, _LONG, _FLOAT, _DOUBLE, _TEXT = T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType()
_POINTS = T.ArrayType(T.ArrayType(_FLOAT))

IMAGE = _fields(height=_INT, width=_INT, nChannels=_INT, mode=_TEXT, data=T.BinaryType())
"""Pixels of one frame, row by row; ``mode`` is RGB."""

HAND = _fields(handedness=_TEXT, confidence=_FLOAT, kp2d=_POINTS, kp3d=_POINTS)
"""One hand: 21 points in pixels, and 21 in space where the method has them (else null)."""
HANDS = T.ArrayType(HAND)

REWARD_FRAME = _fields(index=_LONG, timestamp_s=_DOUBLE)
REWARD = _fields(reward_score=T.ArrayType(_DOUBLE), robometer_success=T.ArrayType(_DOUBLE), reward_frames=T.ArrayType(REWARD_FRAME))

MATCH = _fields(n_gt=_LONG, n_matched=_LONG, errs=T.ArrayType(T.ArrayType(_DOUBLE)))

LIST_ATTRIBUTES = frozenset({"llm_verbs", "llm_objects"})
_TEXT_BEFORE = ["task", *("llm_description" + x for x in ("", "2")), "which_llm_description", "llm_type"]
METADATA = T.StructType(
    [T.StructField(x, T.StringType()) for x in _TEXT_BEFORE]
    + [T.StructField(x, T.ArrayType(T.StringType())) for x in ("llm_verbs", "llm_objects")]
    + [T.StructField(x, T.StringType()) for x in "environment object session_name".split()]
    + [T.StructField("annotated", T.BooleanType())]
    + [T.StructField(x, T.StringType()) for x in "annotator_version extra description description2 type".split()]
)

_FINGERS = {"IndexFinger": 5, "LittleFinger": 5, "MiddleFinger": 5, "RingFinger": 5, "Thumb": 4}


def _joints() -> tuple[str, ...]:
    """68 upper-body joints, in order of name."""
    found = ["hip", *(f"neck{i}" for i in range(1, 5)), *(f"spine{i}" for i in range(1, 8))]
    for side in ("left", "right"):
        found += [side + x for x in ("Arm", "Forearm", "Hand", "Shoulder")]
        for finger, parts in _FINGERS.items():
            found += [side + finger + x for x in ("IntermediateBase", "IntermediateTip", "Knuckle", "Tip", "Metacarpal")[:parts]]
    return tuple(sorted(found))


JOINTS = _joints()
TRANSFORM_JOINTS = ("camera", *JOINTS)
TRAJECTORY_FIELDS = ("camera/intrinsic", *("confidences/" + j for j in JOINTS), *("transforms/" + j for j in TRANSFORM_JOINTS))
DEFAULT_TRAJECTORY_FIELDS = ("camera/intrinsic", *("transforms/" + j for j in ("camera", "leftHand", "rightHand")))


def trajectory_type(field: str) -> T.DataType:
    """3 x 3 for the intrinsic, N x 4 x 4 for transforms, N for confidences."""
    rank = {"camera": 2, "transforms": 3, "confidences": 1}[field.split("/")[0]]
    kind: T.DataType = T.FloatType()
    for _ in range(rank):
        kind = T.ArrayType(kind)
    return kind
