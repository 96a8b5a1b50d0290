"""Names of wire codes.  Unknown codes have no name and keep their number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code tables of the protocols.
ETH_TYPE = {0x0800: "Ipv4", 0x0806: "Arp", 0x0808: "FrameRelayArp", 0x8100: "Vlan", 0x8137: "Novell8137", 0x8138: "Novell8138", 0x86DD: "Ipv6", 0x8847: "MplsUnicast", 0x8848: "MplsMulticast"}
IP_PROTOCOL = {
    0: "Hopopt", 1: "Icmp", 2: "Igmp", 3: "Ggp", 4: "Ipv4", 5: "St", 6: "Tcp", 7: "Cbt", 8: "Egp", 9: "Igp", 10: "BbnRccMon", 11: "NvpII", 12: "Pup", 13: "Argus", 14: "Emcon",
    15: "Xnet", 16: "Chaos", 17: "Udp", 18: "Mux", 19: "DcnMeas", 20: "Hmp", 21: "Prm", 22: "XnsIdp", 23: "Trunk1", 24: "Trunk2", 25: "Leaf1", 26: "Leaf2", 27: "Rdp", 28: "Irtp",
    29: "IsoTp4", 30: "Netblt", 31: "MfeNsp", 32: "MeritInp", 33: "Dccp", 34: "ThreePc", 35: "Idpr", 36: "Xtp", 37: "Ddp", 38: "IdprCmtp", 39: "TpPlusPlus", 40: "Il", 41: "Ipv6",
    42: "Sdrp", 43: "Ipv6Route", 44: "Ipv6Frag", 45: "Idrp", 46: "Rsvp", 47: "Gre", 48: "Dsr", 49: "Bna", 50: "Esp", 51: "Ah", 52: "INlsp", 53: "Swipe", 54: "Narp", 55: "Mobile",
    56: "Tlsp", 57: "Skip", 58: "Ipv6Icmp", 59: "Ipv6NoNxt", 60: "Ipv6Opts", 61: "AnyHostInternalProtocol", 62: "Cftp", 63: "AnyLocalNetwork", 64: "SatExpak", 65: "Kryptolan",
    66: "Rvd", 67: "Ippc", 68: "AnyDistributedFileSystem", 69: "SatMon", 70: "Visa", 71: "Ipcv", 72: "Cpnx", 73: "Cphb", 74: "Wsn", 75: "Pvp", 76: "BrSatMon", 77: "SunNd",
    78: "WbMon", 79: "WbExpak", 80: "IsoIp", 81: "Vmtp", 82: "SecureVmtp", 83: "Vines", 84: "Iptm", 85: "NsfnetIgp", 86: "Dgp", 87: "Tcf", 88: "Eigrp", 89: "Ospfigp",
    90: "SpriteRpc", 91: "Larp", 92: "Mtp", 93: "Ax25", 94: "IpIp", 95: "Micp", 96: "SccSp", 97: "Etherip", 98: "Encap", 99: "AnyPrivateEncryptionScheme", 100: "Gmtp", 101: "Ifmp",
    102: "Pnni", 103: "Pim", 104: "Aris", 105: "Scps", 106: "Qnx", 107: "AN", 108: "IpComp", 109: "Snp", 110: "CompaqPeer", 111: "IpxInIp", 112: "Vrrp", 113: "Pgm",
    114: "Any0HopProtocol", 115: "L2tp", 116: "Ddx", 117: "Iatp", 118: "Stp", 119: "Srp", 120: "Uti", 121: "Smp", 122: "Sm", 123: "Ptp", 124: "IsisOverIpv4", 125: "Fire",
    126: "Crtp", 127: "Crudp", 128: "Sscopmce", 129: "Iplt", 130: "Sps", 131: "Pipe", 132: "Sctp", 133: "Fc", 134: "RsvpE2eIgnore", 135: "MobilityHeader", 136: "UdpLite",
    137: "MplsInIp", 138: "Manet", 139: "Hip", 140: "Shim6", 141: "Wesp", 142: "Rohc", 143: "Ethernet", 144: "Aggfrag", 145: "Nsh",
}
ARPHRD = {0: "NETROM", 1: "ETHER", 2: "EETHER", 3: "AX25", 4: "PRONET", 5: "CHAOS", 6: "IEEE802", 7: "ARCNET", 8: "APPLETLK", 15: "DLCI", 19: "ATM", 23: "METRICOM", 24: "IEEE1394", 27: "EUI64", 32: "INFINIBAND", 256: "SLIP", 257: "CSLIP", 258: "SLIP6", 259: "CSLIP6", 260: "RSRVD", 264: "ADAPT", 270: "ROSE", 271: "X25", 272: "HWX25", 280: "CAN", 290: "MCTP", 512: "PPP", 513: "CISCOHDLC", 516: "LAPB", 517: "DDCMP", 518: "RAWHDLC", 519: "RAWIP", 768: "TUNNEL", 769: "TUNNEL6", 770: "FRAD", 771: "SKIP", 772: "LOOPBACK", 773: "LOCALTLK", 774: "FDDI", 775: "BIF", 776: "SIT", 777: "IPDDP", 778: "IPGRE", 779: "PIMREG", 780: "HIPPI", 781: "ASH", 782: "ECONET", 783: "IRDA", 784: "FCPP", 785: "FCAL", 786: "FCPL", 787: "FCFABRIC", 800: "IEEE802TR", 801: "IEEE80211", 802: "IEEE80211PRISM", 803: "IEEE80211RADIOTAP", 804: "IEEE802154", 805: "IEEE802154PHY", 0xFFFE: "NONE", 0xFFFF: "VOID"}
ARP_OPERATION = {0: "Reserved", 1: "Request", 2: "Reply", 3: "RequestReverse", 4: "ReplyReverse", 5: "DrarpRequest", 6: "DrarpReply", 7: "DrarpError", 8: "InArpRequest", 9: "InArpReply", 10: "ArpNak", 11: "MarsRequest", 12: "MarsMulti", 13: "MarsMServ", 14: "MarsJoin", 15: "MarsLeave", 16: "MarsNak", 17: "MarsUnserv", 18: "MarsSJoin", 19: "MarsSLeave", 20: "MarsGrouplistRequest", 21: "MarsGrouplistReply", 22: "MarsRedirectMap", 23: "MaposUnarp", 24: "OpExp1", 25: "OpExp2"}
ARP_HARDWARE = {0: "Reserved", 1: "Ethernet", 2: "ExperimentalEthernet", 3: "AmateurRadioAx25", 4: "ProteonPronetTokenRing", 5: "Chaos", 6: "Ieee802Networks", 7: "Arcnet", 8: "Hyperchannel", 9: "Lanstar", 10: "AutonetShortAddress", 11: "Localtalk", 12: "Localnet", 13: "Ultralink", 14: "Smds", 15: "FrameRelay", 16: "Atm16", 17: "Hdlc", 18: "FibreChannel", 19: "Atm19", 20: "SerialLine", 21: "Atm21", 22: "MilStd188220", 23: "Metricom", 24: "Ieee1394", 25: "Mapos", 26: "Twinaxial", 27: "Eui64", 28: "Hiparp", 29: "Iso7816_3", 30: "ArpSec", 31: "IpsecTunnel", 32: "InfiniBand", 33: "Tia102", 34: "WiegandInterface", 35: "PureIp", 36: "HwExp1", 37: "Hfi", 38: "UnifiedBus", 256: "HwExp2", 257: "AEthernet"}
DHCP_OP = {1: "BootRequest", 2: "BootReply"}
DHCP_OPTION = {0: "Pad", 1: "SubnetMask", 3: "Router", 6: "DomainNameServer", 12: "HostName", 15: "DomainName", 50: "RequestedIpAddress", 51: "IpAddressLeaseTime", 53: "MessageType", 54: "ServerIdentifier", 55: "ParameterRequestList", 58: "RenewalTime", 59: "RebindingTime", 60: "VendorClassIdentifier", 61: "ClientIdentifier", 255: "End"}
DNS_OPCODE = {0: "Query", 1: "InverseQuery", 2: "Status", 4: "Notify", 5: "Update", 6: "Dso"}
DNS_RCODE = {0: "NoError", 1: "FormErr", 2: "ServFail", 3: "NxDomain", 4: "NotImp", 5: "Refused"}
ICMP_TYPE = {0: "EchoReply", 3: "DestinationUnreachable", 4: "SourceQuench", 5: "Redirect", 8: "EchoRequest", 9: "RouterAdvertisement", 10: "RouterSolicitation", 11: "TimeExceeded", 12: "ParameterProblem", 13: "TimestampRequest", 14: "TimestampReply", 15: "InformationRequest", 16: "InformationReply", 17: "AddressMaskRequest", 18: "AddressMaskReply", 30: "Traceroute", 31: "DatagramConversionError", 32: "MobileHostRedirect", 33: "Ipv6WhereAreYou", 34: "Ipv6IAmHere", 35: "MobileRegistrationRequest", 36: "MobileRegistrationReply", 37: "DomainNameRequest", 38: "DomainNameReply", 39: "Skip", 40: "Photuris", 42: "ExtendedEchoRequest", 43: "ExtendedEchoReply"}
ICMPV6_TYPE = {1: "DestinationUnreachable", 2: "PacketTooBig", 3: "TimeExceeded", 4: "ParameterProblem", 128: "EchoRequest", 129: "EchoReply", 130: "MulticastListenerQuery", 131: "MulticastListenerReport", 132: "MulticastListenerDone", 133: "RouterSolicitation", 134: "RouterAdvertisement", 135: "NeighborSolicitation", 136: "NeighborAdvertisement", 137: "Redirect", 138: "RouterRenumbering", 139: "NodeInformationQuery", 140: "NodeInformationResponse", 141: "InverseNeighborDiscoverySolicitation", 142: "InverseNeighborDiscoveryAdvertisement", 143: "MulticastListenerReportV2", 144: "HomeAgentAddressDiscoveryRequest", 145: "HomeAgentAddressDiscoveryReply", 146: "MobilePrefixSolicitation", 147: "MobilePrefixAdvertisement", 148: "CertificationPathSolicitation", 149: "CertificationPathAdvertisement"}
IGMP_TYPE = {0x11: "MembershipQuery", 0x12: "V1MembershipReport", 0x13: "Dvmrp", 0x14: "PimV1", 0x15: "CiscoTrace", 0x16: "V2MembershipReport", 0x17: "LeaveGroup", 0x1E: "MulticastTracerouteResponse", 0x1F: "MulticastTraceroute", 0x22: "V3MembershipReport", 0x30: "MulticastRouterAdvertisement", 0x31: "MulticastRouterSolicitation", 0x32: "MulticastRouterTermination"}
NTP_LEAP = {0: "NoWarning", 1: "LastMinute61Seconds", 2: "LastMinute59Seconds", 3: "Alarm"}
NTP_MODE = {0: "Reserved", 1: "SymmetricActive", 2: "SymmetricPassive", 3: "Client", 4: "Server", 5: "Broadcast", 6: "NtpControlMessage", 7: "PrivateUse"}
SCTP_CHUNK = {0: "Data", 1: "Init", 2: "InitAck", 3: "Sack", 4: "Heartbeat", 5: "HeartbeatAck", 6: "Abort", 7: "Shutdown", 8: "ShutdownAck", 9: "Error", 10: "CookieEcho", 11: "CookieAck", 12: "Ecne", 13: "Cwr", 14: "ShutdownComplete", 15: "Authentication", 0x84: "Padding", 0xC0: "ForwardTsn", 0xC1: "AddressConfigurationChange"}
SLL_PACKET = {0: "SentToUs", 1: "Broadcast", 2: "Multicast", 3: "OtherHost", 4: "SentByUs"}
TLS_CONTENT = {20: "ChangeCipherSpec", 21: "Alert", 22: "Handshake", 23: "ApplicationData", 24: "Heartbeat"}
TLS_HANDSHAKE = {0: "HelloRequest", 1: "ClientHello", 2: "ServerHello", 4: "NewSessionTicket", 5: "EndOfEarlyData", 8: "EncryptedExtensions", 11: "Certificate", 12: "ServerKeyExchange", 13: "CertificateRequest", 14: "ServerHelloDone", 15: "CertificateVerify", 16: "ClientKeyExchange", 20: "Finished", 21: "CertificateUrl", 22: "CertificateStatus", 24: "KeyUpdate", 254: "MessageHash"}
IPV4_OPTION = {0: "EndOfOptions", 1: "NoOperation", 7: "RecordRoute", 10: "ExperimentalMeasurement", 11: "MtuProbe", 12: "MtuReply", 15: "Encode", 25: "QuickStart", 30: "Rfc3692Experiment30", 68: "Timestamp", 82: "Traceroute", 94: "Rfc3692Experiment94", 130: "Security", 131: "LooseSourceRoute", 133: "ExtendedSecurity", 134: "CommercialSecurity", 136: "StreamId", 137: "StrictSourceRoute", 142: "Visa", 144: "ImiTrafficDescriptor", 145: "ExtendedInternetProtocol", 147: "AddressExtension", 148: "RouterAlert", 149: "SelectiveDirectedBroadcast", 150: "Released150", 151: "DynamicPacketState", 152: "UpstreamMulticastPacket", 158: "Rfc3692Experiment158", 205: "ExperimentalFlowControl", 222: "Rfc3692Experiment222"}
TCP_OPTION = {0: "EndOfOptions", 1: "NoOperation", 2: "MaximumSegmentSize", 3: "WindowScale", 4: "SackPermitted", 5: "Sack", 6: "Echo", 7: "EchoReply", 8: "Timestamp", 9: "PartialOrderConnectionPermitted", 10: "PartialOrderServiceProfile", 11: "Cc", 12: "CcNew", 13: "CcEcho", 14: "AlternateChecksumRequest", 15: "AlternateChecksumData", 16: "Skeeter", 17: "Bubba", 18: "TrailerChecksum", 19: "Md5Signature", 20: "ScpsCapabilities", 21: "SelectiveNegativeAcknowledgements", 22: "RecordBoundaries", 23: "CorruptionExperienced", 24: "Snap", 25: "Unassigned25", 26: "TcpCompressionFilter", 27: "QuickStartResponse", 28: "UserTimeout", 29: "Authentication", 30: "MultipathTcp", 34: "FastOpenCookie"}
LINK_TYPE = {0: "Null", 1: "Ethernet", 2: "ExpEthernet", 3: "Ax25", 6: "TokenRing", 7: "Arcnet", 8: "Slip", 9: "Ppp", 10: "Fddi", 101: "Raw", 105: "Ieee80211", 113: "LinuxSll", 119: "PrismHeader", 120: "AironetHeader", 127: "Ieee80211Radiotap", 228: "Ipv4", 229: "Ipv6", 276: "LinuxSll2"}
LSAP = {0xAA: "Snap"}
#: Display order of TCP flags.
TCP_FLAGS = (("CWR", 0x80), ("ECE", 0x40), ("URG", 0x20), ("ACK", 0x10), ("PSH", 0x08), ("RST", 0x04), ("SYN", 0x02), ("FIN", 0x01))


def name_of(code: Column, table: dict[int, str]) -> Column:
    """The code's name, null where it has none."""
    pairs = [x for k, v in table.items() for x in (F.lit(k).cast("bigint"), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), code.cast("bigint"))


def tcp_flags_text(flags: Column) -> Column:
    return F.concat_ws("|", *[F.when(flags.bitwiseAND(bit) != 0, name) for name, bit in TCP_FLAGS])
