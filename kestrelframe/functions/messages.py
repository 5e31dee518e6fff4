"""Texts of reports."""

# Reports carry these texts, and recommendations look for words in them.
EXCESSIVE_BLUR = "Excessive blur (%.1f%% frames blurry)."
MODERATE_BLUR = "Moderate blur detected (%.1f%% frames blurry)."
DISCONNECTED = "Disconnected dataset. Largest contiguous segment is only %.1f%%."
HIGH_REDUNDANCY = "High redundancy: %.1f%% of consecutive frames have near-zero motion."
PURE_ROTATION = "Risk of pure rotation without baseline in %.1f%% of frame pairs."
ABRUPT_JUMPS = "Abrupt jumps or lost tracking detected in %d pairs."
LOW_OVERLAP = "Low sequential overlap (avg %.1f inliers)."
MANY_ISOLATED = "Many isolated frames (%.1f%%)."
TOO_DARK = "Too dark (%.1f%% frames dark)."
RECOMMEND_SHUTTER = "Use faster shutter speed or slower UAV motion."
RECOMMEND_OVERLAP = "Reduce frame sampling interval or capture with more continuous scene overlap."
TOO_FEW_CONTROLS = "NOT_ENOUGH_CONTROLS: %d < 3"
THREE_CONTROLS = "NOT_ENOUGH_CONTROLS: 3 control points is only valid for mathematical unit tests. Production requires minimum 4."
COLLINEAR_CONTROLS = "Control points are nearly collinear or coplanar."
FLAT_CONTROLS = "Insufficient elevation diversity (<0.5m range)."
CLUSTERED_CONTROLS = "Control points are tightly clustered."
SMALL_CONTROL_AREA = "Poor scene coverage: control points are confined to a very small area (<100 m^2)."

# fixed values: reports of masks and viewer artifacts
UNKNOWN_COLOURS = "Unknown colors found in mask: "
EMPTY_SPARSE = "Empty sparse point cloud"
EMPTY_DENSE = "Empty dense point cloud"
